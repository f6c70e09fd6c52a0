"""Scans: what the plans' scan nodes denote, as reads that Spark prunes and pushes down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansmith.registry import query, table


def by_row_number(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows by their place in the file (inclusive); the reader numbers them, nothing is sorted."""
    return df.where(F.col("_metadata.row_index").between(first, last))


def nearest(df: DataFrame, vector: list[float], k: int, key: str, column: str) -> DataFrame:
    """The k rows at the highest cosine to a vector: exact, one pass, a top-k at the end. Ties go by key."""
    q = F.array(*[F.lit(float(x)) for x in vector])

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    cosine = dot(F.col(column), q) / (F.sqrt(dot(F.col(column), F.col(column))) * F.sqrt(dot(q, q)))
    return df.select(key, F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_full(spark, sf_dir):
    """SeqScan / CStoreScan: the reader takes only the columns asked for."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter(spark, sf_dir):
    """SeqScan with a filter: both predicates reach the reader."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 500, 1024)")
def scan_index(spark, sf_dir):
    """IndexScan: a key lookup, answered from row-group statistics."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 7, 33, 500, 1024)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 200")
def scan_index_only(spark, sf_dir):
    """IndexOnlyScan: the key column alone."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").between(100, 200)).select("c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 1 OR p_size > 48 OR (p_size BETWEEN 20 AND 22 AND p_retailprice > 950)")
def scan_bitmap(spark, sf_dir):
    """BitmapHeapScan over BitmapOr and BitmapAnd: one predicate."""
    p = F.col("p_size")
    return table(spark, sf_dir, "part").where((p == 1) | (p > 48) | (p.between(20, 22) & (F.col("p_retailprice") > 950))).select("p_partkey", "p_size")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type")
def scan_pruned(spark, sf_dir):
    """PartitionedSeqScan / TsStoreScan: a range of the time column."""
    e = table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-12'")
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM (SELECT *, row_number() OVER () - 1 AS i FROM region) WHERE i BETWEEN 1 AND 3")
def scan_rowid(spark, sf_dir):
    """TidScan / TidRangeScan: rows by their place in the file."""
    return by_row_number(table(spark, sf_dir, "region"), 1, 3).select("r_regionkey", "r_name")


@query("SELECT n_name, k * 10 AS k10 FROM (SELECT n_name, n_regionkey + 1 AS k FROM nation) WHERE k > 3")
def scan_subquery(spark, sf_dir):
    """SubqueryScan: a derived table, which the optimizer inlines."""
    inner = table(spark, sf_dir, "nation").select("n_name", (F.col("n_regionkey") + 1).alias("k"))
    return inner.where("k > 3").select("n_name", (F.col("k") * 10).alias("k10"))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(i * i AS BIGINT) AS square FROM range(0, 50, 5) AS t(i)")
def scan_function(spark, sf_dir):
    """FunctionScan: a table function."""
    return spark.range(0, 50, 5).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square"))


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(k, v)")
def scan_values(spark, sf_dir):
    """ValuesScan: literal rows."""
    return spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, NULL) AS t(k, v)")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT a.o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderstatus")
def scan_cte(spark, sf_dir):
    """CteScan: one expression used twice; the exchange is reused."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderstatus")
    return big.join(big.select("o_custkey"), "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
def scan_recursive(spark, sf_dir):
    """RecursiveUnion over a WorkTableScan."""
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


@query(
    """WITH RECURSIVE t(k, path, depth) AS (SELECT r_regionkey, r_name, CAST(1 AS INTEGER) FROM region
    UNION ALL SELECT n_nationkey + 100, path || '/' || n_name, depth + 1 FROM t JOIN nation ON n_regionkey = k WHERE depth < 2)
    SELECT path, depth FROM t"""
)
def start_with(spark, sf_dir):
    """StartWithOp: a hierarchy, as a recursive query."""
    table(spark, sf_dir, "region").createOrReplaceTempView("sw_region")
    table(spark, sf_dir, "nation").createOrReplaceTempView("sw_nation")
    return spark.sql(
        "WITH RECURSIVE t(k, path, depth) AS (SELECT r_regionkey, r_name, 1 FROM sw_region UNION ALL SELECT n_nationkey + 100, path || '/' || n_name, depth + 1 FROM t JOIN sw_nation ON n_regionkey = k WHERE depth < 2) SELECT path, depth FROM t"
    )


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def scan_json(spark, sf_dir):
    """A field of a JSON column, parsed once with a schema."""
    return table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query()
def scan_sample(spark, sf_dir):
    """SampleScan: a Bernoulli sample, the operator's own meaning."""
    return table(spark, sf_dir, "lineitem").sample(0.1, 42).select("l_orderkey", "l_linenumber")


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, vec_id LIMIT 10"""
)
def ann_topk(spark, sf_dir):
    """AnnIndexScan: the ten vectors nearest to one, exactly."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id = 0").head()["embedding"], 10, "vec_id", "embedding")


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def scan_cached(spark, sf_dir):
    """ImCStoreScan: a cached table in columns, whose batches are pruned by their statistics; both uses read the cache."""
    days = table(spark, sf_dir, "lineitem").select("l_shipdate").persist()
    return days.where("l_shipdate >= timestamp'1998-01-01'").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS i FROM lineitem")
def partition_iterator_all(spark, sf_dir):
    """PartitionIterator over the rows of all order keys."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("i"))
