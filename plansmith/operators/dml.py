"""Changes to tables, as the tables after them: row-level writes need a table format that isn't here, so each is a copy on write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.registry import query, table


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which the condition is true get new values; one pass."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Without the rows for which the condition is true; those for which it is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target with the source's values where keys match, and the source's other rows. The source has a key once at most."""
    s = source.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__new"))
    joined = target.join(s, keys, "full")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """UPDATE … FROM: target columns take source columns where keys match; the source has a key once at most."""
    s = source.select(*keys, *[F.col(v).alias(f"__{c}") for c, v in values.items()], F.lit(True).alias("__hit"))
    joined = target.join(s, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_rows(spark, sf_dir):
    """Insert: appended rows."""
    return table(spark, sf_dir, "region").unionByName(spark.sql("SELECT 99 AS r_regionkey, 'ATLANTIS' AS r_name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(spark, sf_dir):
    return update(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def delete_rows(spark, sf_dir):
    return delete(table(spark, sf_dir, "orders"), F.expr("o_orderstatus = 'F' and o_totalprice > 100000")).select("o_orderkey")


@query("SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN v ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN (SELECT s_suppkey * 3 AS k, 'MERGED' AS v FROM supplier) ON c_custkey = k")
def merge_rows(spark, sf_dir):
    """Merge: matched rows change, the others are added."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.lit("MERGED").alias("c_mktsegment"))
    return merge(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), s, ["c_custkey"], ["c_mktsegment"])


@query("SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN n ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def update_from_aggregate(spark, sf_dir):
    """The rewrite of a correlated update: one aggregate and one left join in place of a subquery for every row."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("n"))
    return update_from(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), sums, ["o_orderkey"], {"o_totalprice": "n"})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_regionkey = 2")
def replace_rows(spark, sf_dir):
    """Replace: the rows of one condition overwritten as a whole."""
    n = table(spark, sf_dir, "nation")
    return delete(n, F.col("n_regionkey") == 2).select("n_nationkey", "n_name").unionByName(n.where("n_regionkey = 2").select("n_nationkey", F.lower("n_name").alias("n_name")))
