"""A corpus of plans made from lineitem: each order is a plan, each line a node.

The Spark side writes EXPLAIN texts and parses them again; the SQL side (``NODES_SQL``) computes the same nodes from the columns, so the two
share no code but this module's lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.plans.vocabulary import STREAMING, variant
from plansmith.storage import new_folder

TYPES = [
    "Seq Scan", "Partitioned Seq Scan", "Index Scan", "Index Only Scan", "CStore Scan", "Bitmap Heap Scan", "Subquery Scan", "Nested Loop", "Hash Join", "Merge Join", "Hash", "Sort", "Vector Sort",
    "Streaming(type: REDISTRIBUTE)", "Streaming(type: BROADCAST)", "Streaming(type: GATHER)", "Vector Streaming(type: REDISTRIBUTE)", "HashAggregate", "Group Aggregate", "Unique", "Materialize",
    "Update", "Row Adapter", "Limit", "Seq Scan", "Vector Nest Loop",
]
FILTERS = [
    "(grade = '17')", "(name ~~ '%important%'::text)", "(id IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13))", "(hashed SubPlan 1)", "(ts > now())", "(amount > 10)",
    "(to_char(d, 'YYYY'::text) = '2024'::text)", "((code)::text = '5120'::text)",
]
#: Numbers of a node, from the line's columns (whole numbers in both engines).
NUMBERS = {
    "k": "(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 26",
    "plan_rows": "CASE l_suppkey % 5 WHEN 0 THEN 10 WHEN 1 THEN CAST(l_quantity AS BIGINT) WHEN 2 THEN CAST(l_quantity AS BIGINT) * 100 ELSE CAST(l_quantity AS BIGINT) * 700 END",
    "act_rows": "CASE l_partkey % 4 WHEN 0 THEN l_partkey % 90 WHEN 1 THEN (l_partkey * 37 + l_orderkey) % 3000 ELSE (l_partkey * 41 + l_orderkey * 3) % 260000 END",
    "loops": "1 + (l_orderkey + l_linenumber) % 3",
    "act_time": "(l_orderkey * 7 + l_partkey) % 5000",
    "cost": "(l_partkey * 3 + l_suppkey) % 9000",
    "has_filter": "CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END",
    "filter_no": "(l_suppkey + l_partkey) % 8",
    "removed": "CASE WHEN l_partkey % 2 = 0 THEN (l_orderkey * 13 + l_partkey) % 2000 ELSE -1 END",
    "ran": "CASE WHEN l_partkey % 31 = 0 THEN 0 WHEN l_partkey % 29 = 0 THEN 2 ELSE 1 END",
    "mem": "(l_partkey * 11 + l_orderkey) % 150000",
    "batches": "1 + l_suppkey % 3",
    "parts": "1 + l_partkey % 15",
    "rel": "l_suppkey % 6",
}
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _pick(names: list[str], number: str) -> str:
    quoted = [n.replace("'", "''") for n in names]
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(quoted)) + " END"


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, explain_text: one text for each order key."""
    from pyspark.sql import Window

    from plansmith.plans.parser import short_methods

    short_methods(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    n = lines.select("l_orderkey", F.row_number().over(w).alias("no"), "l_linenumber", *[F.expr(e).alias(k) for k, e in NUMBERS.items()])
    quote = lambda names: F.array(*[F.lit(x) for x in names])
    kind, text = F.element_at(quote(TYPES), F.col("k").cast("int") + 1), F.element_at(quote(FILTERS), F.col("filter_no").cast("int") + 1)
    indent = F.when(F.col("no") == 1, 0).otherwise(2 * F.col("l_linenumber"))
    pad = lambda more: F.repeat(F.lit(" "), indent.cast("int") + more)
    scan = kind.endswith("Scan") & ~kind.startswith("Subquery") | (kind == "Update")
    run = F.when(F.col("ran") == 1, F.format_string(" (actual time=0.010..%d.500 rows=%d loops=%d)", "act_time", "act_rows", "loops")).when(F.col("ran") == 2, " (Actual time: never executed)").otherwise("")
    head = F.concat(pad(0), F.when(F.col("no") > 1, "->  ").otherwise(""), kind, F.when(scan, F.concat(F.lit(" on t"), "rel")).otherwise(""), F.format_string("  (cost=0.00..%d.25 rows=%d width=8)", "cost", "plan_rows"), run)

    def prop(cond, label, value):
        return F.when(cond, F.concat(pad(6), F.lit(f"{label}: "), value))

    props = [
        prop(F.col("has_filter") == 1, "Filter", text),
        prop(F.col("removed") >= 0, "Rows Removed by Filter", F.col("removed").cast("string")),
        prop(kind.isin("Sort", "Vector Sort"), "Sort Key", F.concat(F.lit("c"), "rel")),
        prop(kind.isin("Sort", "Vector Sort"), "Sort Method", F.when(F.col("batches") == 2, F.concat(F.lit("external merge  Disk: "), "mem", F.lit("kB"))).otherwise(F.concat(F.lit("quicksort  Memory: "), "mem", F.lit("kB")))),
        prop(kind.isin("Hash", "HashAggregate"), "Buckets", F.concat(F.lit("1024  Batches: "), "batches", F.lit("  Memory Usage: "), "mem", F.lit("kB"))),
        prop(kind == "Partitioned Seq Scan", "Selected Partitions", F.concat(F.lit("1.."), "parts")),
        prop(kind.isin("Index Scan", "Index Only Scan"), "Index Cond", F.lit("(id = 5)")),
        prop(kind.isin("Index Scan", "Index Only Scan"), "Heap Fetches", F.col("mem").cast("string")),
        prop(kind.isin("Hash Join", "Merge Join"), "Join Filter", F.lit("(a.x > b.y)")),
        prop(kind.isin("Hash Join", "Merge Join"), "Rows Removed by Join Filter", F.col("mem").cast("string")),
    ]
    block = F.concat_ws("\n", head, *props)
    grouped = n.groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.array_sort(F.collect_list(F.struct("no", block.alias("b")))).alias("x"))
    return grouped.select("plan_id", F.concat(F.lit("QUERY PLAN\n-----\n"), F.array_join("x.b", "\n"), F.lit("\nTotal runtime: "), F.expr("plan_id % 900"), F.lit(".5 ms")).alias("explain_text"))


_stored: dict[tuple[str, str], str] = {}


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for each session and folder of tables, and read again."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        folder = new_folder(spark, "plans")
        plan_texts(spark, sf_dir).write.parquet(folder)
        _stored[key] = folder
    return spark.read.parquet(_stored[key])


_TYPE_SQL = _pick([variant(t.split("(")[0]) for t in TYPES], "k")
_STREAM_SQL = "CASE k " + " ".join(f"WHEN {i} THEN '{STREAMING[t.split(': ')[1][:-1]]}'" for i, t in enumerate(TYPES) if "(" in t) + " END"
_SCAN_NOS = ", ".join(str(i) for i, t in enumerate(TYPES) if t.endswith("Scan") and not t.startswith("Subquery") or t == "Update")

#: n: nodes; cl: (plan_id, anc, ord) pairs of ancestors; p: parents; d: nodes with depth.
NODES_SQL = f"""
WITH RECURSIVE base AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS ord, l_linenumber AS ln,
    {", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in NUMBERS.items())} FROM lineitem),
n AS (SELECT plan_id, CAST(ord AS INTEGER) AS ord, CASE WHEN ord = 0 THEN -1 ELSE 2 * ln END AS e, k, {_TYPE_SQL} AS node_type, {_STREAM_SQL} AS streaming,
    CASE WHEN k IN ({_SCAN_NOS}) THEN 't' || rel END AS relation, CAST(plan_rows AS DOUBLE) AS plan_rows, cost + 0.25 AS total_cost,
    CASE ran WHEN 1 THEN CAST(act_rows AS DOUBLE) WHEN 2 THEN 0.0 END AS act_rows, CASE ran WHEN 1 THEN CAST(loops AS DOUBLE) WHEN 2 THEN 1.0 END AS loops,
    CASE ran WHEN 1 THEN act_time + 0.5 WHEN 2 THEN 0.0 END AS act_time, ran = 1 AS executed,
    CASE WHEN has_filter = 1 THEN {_pick(FILTERS, "filter_no")} END AS filter, CASE WHEN removed >= 0 THEN CAST(removed AS DOUBLE) END AS removed,
    CASE WHEN k IN (11, 12) AND batches = 2 THEN 'external merge' WHEN k IN (11, 12) THEN 'quicksort' END AS sort_method,
    CASE WHEN k IN (11, 12) THEN 'c' || rel END AS sort_key, CASE WHEN k IN (11, 12) AND batches = 2 THEN mem END AS sort_disk,
    CASE WHEN k IN (10, 17) THEN batches END AS hash_batches, CASE WHEN k IN (10, 17) THEN mem WHEN k IN (11, 12) AND batches = 2 THEN mem END AS peak_kb,
    CASE WHEN k = 1 THEN parts END AS parts, CASE WHEN k IN (2, 3) THEN mem END AS heap_fetches, CASE WHEN k IN (8, 9) THEN mem END AS join_removed FROM base),
cl AS (SELECT a.plan_id, a.ord AS anc, d.ord AS ord FROM n a JOIN n d ON a.plan_id = d.plan_id AND a.ord < d.ord
    WHERE a.e < (SELECT min(x.e) FROM n x WHERE x.plan_id = a.plan_id AND x.ord > a.ord AND x.ord <= d.ord)),
p AS (SELECT plan_id, ord, max(anc) AS parent, count(*) AS above FROM cl GROUP BY 1, 2),
d AS (SELECT n.*, p.parent, CAST(coalesce(p.above, 0) + 1 AS INTEGER) AS depth FROM n LEFT JOIN p USING (plan_id, ord))
"""
