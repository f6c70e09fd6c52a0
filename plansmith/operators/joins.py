"""Joins: strategies by hint, semantics by type, an as-of join and a join of near values without a quadratic step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansmith.registry import query, table

#: A side whose estimated size is below this goes to every executor; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if, and only if, its estimated size allows it."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (nulls if there is none).

    Both sides go through one window in order of time, so a key is sorted once and no pairs are made. Equal right times: the largest values win.
    """
    l = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(_struct_of(right, values)).alias("r"))
    r = right.select(F.lit(None).cast(_struct_of(left, left.columns)).alias("l"), F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.struct(*values).alias("r"))
    w = Window.partitionBy("k").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("last", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    return both.select("l.*", *[F.col(f"last.{v}").alias(v) for v in values])


def _struct_of(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """An inner join whose large side may have hot keys: each goes to ``salts`` partitions, the other side is repeated as often."""
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    return salted.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), [key, "__salt"]).drop("__salt")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, width: float) -> DataFrame:
    """An inner join on equal keys and values (doubles) that differ by less than ``width``, without a pair for each two rows of a key.

    Values go to cells of a power of two of at least ``width``, so finding a cell rounds nothing and near values are in the same or in neighbouring
    cells. A left row is in its own cell, a right row in three, of which one is the left row's. What isn't finite is near nothing.
    """
    size = 2.0 ** math.ceil(math.log2(width))
    limit = F.lit(1 << 62)  # leaves room for neighbours
    finite = lambda v: F.abs(v) < float("inf")
    cell = lambda v: F.greatest(F.least(F.floor(F.col(v) / size), limit), -limit)
    l = left.where(finite(left_value)).withColumn("__cell", cell(left_value))
    r = right.where(finite(right_value)).withColumn("__cell", F.explode(F.sequence(cell(right_value) - 1, cell(right_value) + 1)))
    # merged: a broadcast side would leave the work to the few tasks that read the other
    return l.join(r.hint("merge"), [*keys, "__cell"]).where(F.abs(F.col(left_value) - F.col(right_value)) < width).drop("__cell")


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def _on() -> Column:
    return F.col("o_custkey") == F.col("c_custkey")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_inner(spark, sf_dir):
    """HashJoin: the optimizer chooses by size."""
    j = _orders(spark, sf_dir).join(_customers(spark, sf_dir), _on())
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), _on(), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), _on(), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def join_right_semi(spark, sf_dir):
    """RightSemi: the other side is kept, so sides swap."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal < 0"), _on(), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def join_right_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), _on(), "left_anti").select("o_orderkey")


_WHOLE = "SELECT coalesce(o_orderkey, -1) AS o_orderkey, c_mktsegment FROM orders {} customer ON o_custkey = c_custkey AND c_acctbal > 0"


def _whole(spark, sf_dir, how):
    """Both tables whole: the balance is part of the join condition, so it decides what finds a partner and drops no row of a kept side."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _orders(spark, sf_dir).join(c, _on() & (F.col("c_acctbal") > 0), how)


def _whole_rows(spark, sf_dir, how):
    return _whole(spark, sf_dir, how).select(F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "c_mktsegment")


@query(_WHOLE.format("LEFT JOIN"))
def join_left_all(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "left")


@query(_WHOLE.format("RIGHT JOIN"))
def join_right_all(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "right")


@query(_WHOLE.format("FULL JOIN"))
def join_full_all(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "full")


@query("SELECT coalesce(o_orderkey, -1) AS o_orderkey, coalesce(c_custkey, -1) AS c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_orderkey IS NULL OR c_custkey IS NULL")
def join_anti_full_all(spark, sf_dir):
    """LeftAntiFull / RightAntiFull over whole tables."""
    return _whole(spark, sf_dir, "full").where("o_orderkey is null or c_custkey is null").selectExpr("coalesce(o_orderkey, -1L) AS o_orderkey", "coalesce(c_custkey, -1L) AS c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey ELSE 3 END FROM supplier)")
def join_not_in_null_aware(spark, sf_dir):
    """LeftAntiSemiNotIn: the null-aware anti join that NOT IN means."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("ni_nation")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("ni_supplier")
    return spark.sql("SELECT n_nationkey FROM ni_nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey ELSE 3 END FROM ni_supplier)")


@query("SELECT a.r_name AS a, b.n_name AS b FROM region a JOIN nation b ON a.r_regionkey < b.n_regionkey")
def join_theta(spark, sf_dir):
    """NestedLoop: an inequality of two tables of fixed size, the smaller broadcast behind a check of its size."""
    a, b = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return b.join(sized(a), F.col("r_regionkey") < F.col("n_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    """The operator itself, on two tables of fixed size."""
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


def _strategy(hint):
    def run(spark, sf_dir):
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        right = sized(c) if hint == "broadcast" else c.hint(hint)
        return table(spark, sf_dir, "orders").join(right, _on()).groupBy("c_nationkey").agg(F.count("*").alias("n"))

    return run


_BY_NATION = "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


@query(_BY_NATION)
def join_broadcast(spark, sf_dir):
    """VectorHashJoin with a small build side."""
    return _strategy("broadcast")(spark, sf_dir)


@query(_BY_NATION)
def join_merge(spark, sf_dir):
    """MergeJoin: both sides sorted by the key."""
    return _strategy("merge")(spark, sf_dir)


@query(_BY_NATION)
def join_shuffle_hash(spark, sf_dir):
    """VectorSonicHashJoin: a hash table for each partition."""
    return _strategy("shuffle_hash")(spark, sf_dir)


@query(
    """WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
    SELECT e.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts"""
)
def join_asof(spark, sf_dir):
    """VectorAsofJoin: each event with the user's last event of the first type."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    marked = e.crossJoin(F.broadcast(first))  # one row
    right = marked.where("event_type = first").select("user_id", F.col("ts").alias("rts"), F.col("value").alias("last_value"))
    return asof_join(marked.where("event_type <> first").select("event_id", "user_id", "ts"), right, "user_id", "ts", "rts", ["last_value"]).select("event_id", "last_value")


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def join_salted(spark, sf_dir):
    """Hybrid and skewed movement: hot keys of the large side spread over salts."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return salted_join(l, o, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 50")
def join_self(spark, sf_dir):
    """A join filter beside equal keys: near balances meet in cells."""
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    b = a.select(F.col("c_custkey").alias("other"), "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("bal"))
    return band_join(a, b, ["c_nationkey", "c_mktsegment"], "c_acctbal", "bal", 50).where("c_custkey < other").select("c_custkey", "other")
