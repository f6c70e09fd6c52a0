"""Window functions and their frames. Each window is partitioned by a key, so no window gathers the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plansmith.registry import query, table

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_TIES = "PARTITION BY c_nationkey ORDER BY c_mktsegment"


def _ordered():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query(
    f"""SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, round(percent_rank() OVER w, 9) AS p,
    CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS n FROM customer WINDOW w AS ({_TIES})"""
)
def win_rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    n = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.round(F.percent_rank().over(w), 9).alias("p"), F.row_number().over(n).alias("n"))


@query(f"SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1) OVER w AS after FROM orders WINDOW w AS ({_W})")
def win_lag_lead(spark, sf_dir):
    w = _ordered()
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, -1.0).over(w).alias("after"))


@query(
    f"""SELECT o_orderkey, first_value(o_orderstatus) OVER w AS f, last_value(o_orderstatus) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
    coalesce(nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) AS second FROM orders WINDOW w AS ({_W})"""
)
def win_first_last_nth(spark, sf_dir):
    w = _ordered()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.first("o_orderstatus").over(w).alias("f"), F.last("o_orderstatus").over(whole).alias("l"), F.coalesce(F.nth_value("o_orderkey", 2).over(whole), F.lit(-1)).alias("second"))


@query(f"SELECT o_orderkey, CAST(ntile(3) OVER w AS INTEGER) AS third, round(cume_dist() OVER w, 9) AS share FROM orders WINDOW w AS ({_W})")
def win_ntile_cume(spark, sf_dir):
    w = _ordered()
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(3).over(w).alias("third"), F.round(F.cume_dist().over(w), 9).alias("share"))


@query(
    f"""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS three,
    CAST(count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around FROM orders WINDOW w AS ({_W})"""
)
def win_frame_rows(spark, sf_dir):
    w = _ordered()
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).cast("double").alias("three"), F.count("*").over(w.rowsBetween(-1, 1)).alias("around"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM lineitem")
def win_frame_range(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count("*").over(w).alias("near"))


@query("SELECT c_custkey, round(100 * CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) / CAST(sum(abs(CAST(c_acctbal AS DECIMAL(18,2)))) OVER (PARTITION BY c_nationkey) AS DOUBLE), 6) AS percent FROM customer")
def win_share(spark, sf_dir):
    """Share of a group's total."""
    total = F.sum(F.abs(F.col("c_acctbal").cast("decimal(18,2)"))).over(Window.partitionBy("c_nationkey")).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(100 * F.col("c_acctbal") / total, 6).alias("percent"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS events, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def win_sessions(spark, sf_dir):
    """Gaps of over four hours end a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 4 hours"), 0).otherwise(1)
    marked = table(spark, sf_dir, "events").withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w))
    return marked.groupBy("user_id", "s").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("s")
