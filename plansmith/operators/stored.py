"""Operators over tables that are written first: partitioned scans with pruning, foreign sources, materialised steps, changes that are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.operators import dml
from plansmith.registry import query, table
from plansmith.storage import new_folder


def partitioned(df: DataFrame, column: str) -> DataFrame:
    """The same rows from a table with a folder for each value of a column; filters on it choose folders (PartitionFilters), others reach the
    files. Rows of a value are dealt by value first, so each folder has few files."""
    folder = new_folder(df.sparkSession, "partitioned")
    df.repartition(column).write.partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _days(spark, sf_dir) -> DataFrame:
    return partitioned(table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day")), "day")


_DAY = "CAST(ts AS DATE)"


@query(f"SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE {_DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1")
def scan_partitioned(spark, sf_dir):
    """PartitionedSeqScan, PartitionedCStoreScan: only the folders of seven days are listed and read."""
    return _days(spark, sf_dir).where("day between date'2024-01-05' and date'2024-01-11'").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, event_type FROM events WHERE {_DAY} = DATE '2024-01-07' AND event_id IN (SELECT min(event_id) FROM events WHERE {_DAY} = DATE '2024-01-07' UNION ALL SELECT max(event_id) FROM events WHERE {_DAY} = DATE '2024-01-07')")
def scan_partitioned_index(spark, sf_dir):
    """PartitionedIndexScan: a key lookup within one folder."""
    one = _days(spark, sf_dir).where("day = date'2024-01-07'")
    ends = one.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).head()
    return one.where(F.col("event_id").isin(*[x for x in ends if x is not None])).select("event_id", "event_type")


@query(f"SELECT event_id FROM events WHERE {_DAY} = DATE '2024-01-08' AND event_id > 100")
def scan_partitioned_index_only(spark, sf_dir):
    """PartitionedIndexOnlyScan: the key column alone, of one folder."""
    return _days(spark, sf_dir).where("day = date'2024-01-08' and event_id > 100").select("event_id")


@query(f"SELECT event_id FROM events WHERE {_DAY} IN (DATE '2024-01-06', DATE '2024-01-09') AND (value > 90 OR event_type = 'click' AND value < 10)")
def scan_partitioned_bitmap(spark, sf_dir):
    """PartitionedBitmapHeapScan over PartitionedBitmapIndexScan: one predicate within two folders."""
    return _days(spark, sf_dir).where("day in (date'2024-01-06', date'2024-01-09') and (value > 90 or event_type = 'click' and value < 10)").select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def scan_foreign(spark, sf_dir):
    """ForeignScan, VectorForeignScan, DataNodeScan, RemoteSubplanScan: another system's format, read with a schema; the filter goes with the scan."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    folder = new_folder(spark, "foreign")
    c.write.json(folder)
    return spark.read.schema(c.schema).json(folder).where("c_nationkey = 3 and c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def scan_partitioned_foreign(spark, sf_dir):
    """PartitionedForeignScan: another format in folders; one is pruned by its value, the rows by the scan."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderstatus", F.year("o_orderdate").alias("y"))
    folder = new_folder(spark, "foreign")
    o.repartition("y").write.partitionBy("y").orc(folder)
    return spark.read.schema(o.schema).orc(folder).where("y >= 1996").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, CAST(q AS BIGINT) AS q FROM m WHERE q > (SELECT avg(q) FROM m)")
def materialize(spark, sf_dir):
    """Materialize: an aggregate kept for its two uses, in memory and then on disk."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q")).persist()
    return m.crossJoin(F.broadcast(m.agg(F.avg("q").alias("mean")))).where("q > mean").select("l_suppkey", "q")  # one row


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS place FROM supplier")
def gather_merge(spark, sf_dir):
    """GatherMerge: sorted ranges one after the other; a row's place is its range's base, from prefix sums, and its place within."""
    import itertools

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").repartitionByRange("s_acctbal", "s_suppkey").sortWithinPartitions("s_acctbal", "s_suppkey")
    s = s.select("s_suppkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).persist()
    sizes = sorted((r["part"], r["n"]) for r in s.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    bases = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *(n for _, n in sizes)]), strict=False))
    base = F.create_map(*[F.lit(int(x)) for kv in bases.items() for x in kv]) if bases else F.create_map(F.lit(0), F.lit(0))
    return s.select("s_suppkey", (base[F.col("part")] + F.col("id").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias("place"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) UNION ALL SELECT -1, 1.5")
def modify_table(spark, sf_dir):
    """ModifyTable: update, delete and insert, each stored as the table's next version before the next one reads it."""
    folder = new_folder(spark, "modified")

    def stored(df: DataFrame, version: int) -> DataFrame:
        df.write.parquet(f"{folder}/{version}")
        return spark.read.parquet(f"{folder}/{version}")

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    kept = stored(dml.delete(c, F.expr("c_mktsegment = 'BUILDING' and c_acctbal > 5000")).drop("c_mktsegment"), 1)
    changed = stored(dml.update(kept, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}), 2)
    return stored(changed.unionByName(spark.sql("SELECT -1L AS c_custkey, 1.5D AS c_acctbal")), 3)


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_quantity >= 25 GROUP BY 1")
def vector_adapter(spark, sf_dir):
    """VectorAdapter, RowAdapter: rows to batches of columns, a vectorised step over them, and back to rows."""

    def step(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield b.filter(pc.greater_equal(b.column(1), 25.0))

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity").mapInArrow(step, "l_returnflag string, l_quantity double")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
