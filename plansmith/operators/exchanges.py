"""Data movement: each kind of exchange that distributed plans name, as Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.operators.joins import sized
from plansmith.registry import query, table


def redistribute(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute / LocalRedistribute: by a hash of keys."""
    return df.repartition(*[F.col(k) for k in keys])


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """LocalRoundrobin: evenly, without a key."""
    return df.repartition(n)


def range_redistribute(df: DataFrame, *keys: str) -> DataFrame:
    """RangeRedistribute."""
    return df.repartitionByRange(*[F.col(k) for k in keys])


def list_redistribute(df: DataFrame, key: str, lists: dict[str, int], other: int = -1) -> DataFrame:
    """ListRedistribute: named values go to named places; dealt by the place."""
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in lists.items() for x in kv])[F.col(key)], F.lit(other))
    return df.withColumn("place", place).repartition("place")


def split_redistribute(df: DataFrame, *keys: str) -> DataFrame:
    """SplitRedistribute: by keys, where adaptive execution may split a partition that grows too large."""
    return df.hint("rebalance", *keys)


def hybrid(df: DataFrame, keys: list[str], salts: int = 8) -> DataFrame:
    """Hybrid: by keys and a salt, for sums that are added up again afterwards."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).repartition(*keys, "salt")


def part_broadcast(large: DataFrame, small: DataFrame, key: str, hot: list) -> DataFrame:
    """PartRedistributePartBroadcast: hot keys stay where they are and meet a broadcast of their few partners, the others are joined by key."""
    is_hot = F.col(key).isin(hot)
    return large.where(is_hot).join(sized(small.where(is_hot)), key).unionByName(large.where(~is_hot | F.col(key).isNull()).join(small.where(~is_hot), key))


def split_broadcast(large: DataFrame, small: DataFrame, key: str, parts: int = 4) -> DataFrame:
    """SplitBroadcast: the small side goes out in parts of its keys, one broadcast each, so that none holds it whole; each meets the rows of its keys."""
    part = lambda df: F.pmod(F.xxhash64(df[key]), F.lit(parts))
    out = None
    for i in range(parts):
        own = large.where(part(large) == i).join(sized(small.where(part(small) == i)), key)
        out = own if out is None else out.unionByName(own)
    return out


def part_roundrobin(df: DataFrame, key: str, hot: list, n: int = 8) -> DataFrame:
    """PartRedistributePartRoundrobin: rows of hot keys are spread evenly, the others go by key."""
    return df.withColumn("salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*df.columns), F.lit(n))).otherwise(F.lit(0))).repartition(key, "salt")


def part_local(df: DataFrame, key: str, hot: list) -> DataFrame:
    """PartRedistributePartLocal: rows of hot keys stay where they are (to be added up there first), the others go by key."""
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.where(is_hot).unionByName(df.where(~is_hot).repartition(key))


def part_local_broadcast(large: DataFrame, small: DataFrame, key: str, hot: list) -> DataFrame:
    """PartLocalPartBroadcast: the large side stays where it is; of the small side hot keys are broadcast, the others too if their size allows."""
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return large.where(is_hot).join(F.broadcast(small.where(is_hot)), key).unionByName(large.where(~is_hot).join(sized(small.where(~is_hot)), key))


_N = "SELECT {k} AS k, CAST(count(*) AS BIGINT) AS n FROM {t} GROUP BY 1"


def _count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))


@query(_N.format(k="l_suppkey", t="lineitem"))
def stream_redistribute(spark, sf_dir):
    """The exchange by key serves the aggregate after it: one shuffle in all."""
    return _count(redistribute(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey"), "l_suppkey")


@query(_N.format(k="o_orderstatus", t="orders"))
def stream_roundrobin(spark, sf_dir):
    return _count(round_robin(table(spark, sf_dir, "orders").select("o_orderstatus"), 8), "o_orderstatus")


@query(_N.format(k="o_orderdate", t="orders"))
def stream_range(spark, sf_dir):
    return _count(range_redistribute(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate"), "o_orderdate")


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS k, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def stream_list(spark, sf_dir):
    return _count(list_redistribute(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": 0, "MACHINERY": 1}), "place")


@query(_N.format(k="event_type", t="events"))
def stream_split(spark, sf_dir):
    return _count(split_redistribute(table(spark, sf_dir, "events").select("event_type"), "event_type"), "event_type")


@query(_N.format(k="l_returnflag", t="lineitem"))
def stream_hybrid(spark, sf_dir):
    """Sums by key and salt, then by key."""
    partial = hybrid(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey"), ["l_returnflag"]).groupBy("l_returnflag", "salt").agg(F.count("*").alias("n"))
    return partial.groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("n").alias("n"))


@query("SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def stream_part_broadcast(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k0"), "s_nationkey")
    return _count(part_broadcast(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k0")), s, "k0", [1, 2, 3]), "s_nationkey")


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def stream_broadcast(spark, sf_dir):
    """Broadcast, behind a check of the size."""
    return table(spark, sf_dir, "customer").join(sized(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey FROM region")
def stream_gather(spark, sf_dir):
    """Gather: one partition, for a result of a fixed size."""
    return table(spark, sf_dir, "region").select("r_regionkey").coalesce(1)


@query("SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def stream_split_broadcast(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k0"), "s_nationkey")
    return _count(split_broadcast(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k0")), s, "k0"), "s_nationkey")


@query(_N.format(k="l_suppkey", t="lineitem"))
def stream_part_roundrobin(spark, sf_dir):
    """Sums by key and salt, then by key."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    return part_roundrobin(l, "l_suppkey", [1, 2, 3]).groupBy("l_suppkey", "salt").agg(F.count("*").alias("n")).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("n").alias("n"))


@query(_N.format(k="l_suppkey", t="lineitem"))
def stream_part_local(spark, sf_dir):
    return _count(part_local(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", [1, 2, 3]), "l_suppkey")


@query("SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def stream_part_local_broadcast(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k0"), "s_nationkey")
    return _count(part_local_broadcast(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k0")), s, "k0", [1, 2, 3]), "s_nationkey")
