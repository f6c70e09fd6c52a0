"""Sorting, limits, set operations, projections with set-returning functions, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansmith.registry import query, table


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order that leaves no ties. Partial minima go before the exchange, so a hot key isn't gathered."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def top_of_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key before the exchange (WindowGroupLimit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    """Sort and Limit: k rows of each partition, then k of those."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(40).limit(20)


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey")
def sort_multi(spark, sf_dir):
    """Sort: a range exchange, then each partition by itself."""
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").orderBy("c_mktsegment", F.desc_nulls_last("c_acctbal"), "c_custkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 49")
def group_sort(spark, sf_dir):
    """GroupSort: sorted within each key's partition, not over all."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_partkey").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_partkey")


@query("SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    """Append."""
    return table(spark, sf_dir, "customer").select("c_nationkey").union(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) ORDER BY k")
def merge_append_all(spark, sf_dir):
    """MergeAppend: the whole ordered union."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).orderBy("k")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


_A, _B = "SELECT l_partkey % 100 AS k FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_suppkey AS k FROM lineitem WHERE l_linestatus = 'O'"


def _sides(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.where("l_returnflag = 'R'").select((F.col("l_partkey") % 100).alias("k")), l.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("k"))


@query(f"{_A} INTERSECT {_B}")
def intersect_distinct(spark, sf_dir):
    """SetOp: a semi join after an aggregate."""
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT {_B}")
def except_distinct(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(spark, sf_dir):
    """HashSetOp."""
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_query(spark, sf_dir):
    """Unique over a Sort: DISTINCT ON."""
    return distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [(-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_by_group(spark, sf_dir):
    return top_of_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def unique_rows(spark, sf_dir):
    """Unique."""
    return table(spark, sf_dir, "customer").dropDuplicates(["c_mktsegment", "c_nationkey"]).select("c_mktsegment", "c_nationkey")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def explode_words(spark, sf_dir):
    """ProjectSet: a set-returning function in the select list."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.split("n_name", " ")).alias("word"))


@query("SELECT 1 AS one, CAST(6 * 7 AS INTEGER) AS answer, 'x' || 'y' AS xy")
def result_constant(spark, sf_dir):
    """Result."""
    return spark.range(1).select(F.lit(1).alias("one"), (F.lit(6) * F.lit(7)).alias("answer"), F.concat(F.lit("x"), F.lit("y")).alias("xy"))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.fillna(0, ["F", "O", "P"])


@query("SELECT r_regionkey, 'name' AS what, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'upper', upper(r_name) FROM region")
def unpivot_names(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"), F.upper("r_name").alias("upper")).unpivot("r_regionkey", ["name", "upper"], "what", "value")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)")
def scalar_subquery(spark, sf_dir):
    """A scalar subquery: one row, computed once."""
    o = table(spark, sf_dir, "orders")
    mean = o.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"))
    return o.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(mean)).where("o_totalprice > mean").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey)")
def correlated_subquery(spark, sf_dir):
    """A correlated subquery without a join: only a group's largest price can be that far over all others, so two rows of each group are enough."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    top = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("i")).where("i <= 2")
    two = top.groupBy("o_custkey").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(n) for n, c, i in (("key", "o_orderkey", 1), ("most", "o_totalprice", 1), ("next", "o_totalprice", 2))])
    return two.where("most > 1.5 * next").select(F.col("key").alias("o_orderkey"))
