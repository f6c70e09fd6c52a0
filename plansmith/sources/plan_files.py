"""Where plans come from and go to: text files, files of SQL and plans together, CSV batches, Spark's own plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.registry import query


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """plan_id (the file), explain_text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("plan_id"), F.col("value").alias("explain_text"))


def blocks(files: DataFrame) -> DataFrame:
    """Splits texts of SQL and plans into blocks: plan_id, block (from 1), sql_text, explain_text.

    A plan begins at a line ``QUERY PLAN`` or at a first line with costs, and ends at a footer ``(N rows)`` or where SQL begins again; the SQL
    before it belongs to it, less an EXPLAIN in front. One window by file; no row-by-row code.
    """
    lines = files.select("plan_id", F.posexplode(F.split("explain_text", "\r?\n")).alias("no", "raw"))
    t = F.trim("raw")
    sql = t.rlike(r"(?i)^(select|insert|update|delete|merge|with|explain|create)\b") & ~t.contains("(cost=") & ~t.rlike(r"(?i)^(insert|update|delete|merge) on ")
    kind = F.when(t.rlike(r"^\(\d+ rows?\)$"), "footer").when(t == "", "blank").when(t.startswith("---"), "rule").when((t == "QUERY PLAN") | t.contains("(cost="), "plan").when(sql, "sql")
    w = Window.partitionBy("plan_id").orderBy("no")
    marked = lines.withColumn("kind", kind).withColumn("state", F.last(F.when(F.col("kind").isin("plan", "sql", "footer"), F.col("kind")), ignorenulls=True).over(w))
    new = (F.col("state") == "sql") & (F.coalesce(F.lag("state").over(w), F.lit("footer")) != "sql") | (F.col("state") == "plan") & F.coalesce(F.lag("state").over(w), F.lit("footer")).isin("footer")
    told = marked.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("block > 0 and state in ('sql', 'plan') and coalesce(kind, '') not in ('rule', 'blank')")
    line = lambda state: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("no", "raw")))), lambda x: x["raw"]), "\n")
    out = told.groupBy("plan_id", "block").agg(line("sql").alias("sql_text"), line("plan").alias("explain_text"))
    return out.withColumn("sql_text", F.nullif(strip_explain(F.col("sql_text")), F.lit("")))


def strip_explain(sql):
    """The statement inside an EXPLAIN."""
    return F.trim(F.regexp_replace(sql, r"(?i)^\s*explain\s+((analyze|verbose|performance|\([^)]*\))\s+)*", ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """plan_id, sql_text, explain_text, parse_status of a CSV batch: columns ``sql`` and ``explain`` in any case and place. A bad row says so and stops nothing."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    names = {c.strip().lower(): c for c in raw.columns}
    if "explain" not in names:
        raise ValueError("the batch has no column named explain")
    sql = F.col(f"`{names['sql']}`") if "sql" in names else F.lit(None).cast("string")
    text = F.col(f"`{names['explain']}`")
    status = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "error: empty explain text").when(~text.rlike(r"\(cost=|->|Scan|Result"), "error: no plan nodes").otherwise("ok")
    return raw.select(F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]).alias("plan_id"), sql.alias("sql_text"), text.alias("explain_text"), status.alias("parse_status"))


def write_csv(summary: DataFrame, path: str) -> None:
    """Booleans as Y and N, arrays joined by semicolons."""
    shown = [F.when(F.col(n), "Y").otherwise("N").alias(n) if t == "boolean" else F.array_join(n, ";").alias(n) if t.startswith("array") else F.col(n) for n, t in summary.dtypes]
    summary.select(*shown).write.csv(path, header=True)


def write_json(found: DataFrame, path: str) -> None:
    """One object a plan with its findings."""
    found.groupBy("plan_id").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "plan_id"])).alias("findings")).write.json(path)


def own_plan(df: DataFrame) -> str:
    """Spark's plan of a DataFrame, with its costs."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))


_MIXED = "SELECT a FROM t;\nQUERY PLAN\n---------\nSeq Scan on t  (cost=0.00..1.00 rows=5 width=4)\n  Filter: (a > 1)\n(2 rows)\nEXPLAIN ANALYZE SELECT b FROM u;\nSeq Scan on u  (cost=0.00..2.00 rows=7 width=4)\n(1 row)"


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'SELECT a FROM t;', CAST(3 AS INTEGER)), (2, 'SELECT b FROM u;', 1)) AS t(block, sql_text, lines)")
def segment_blocks(spark, sf_dir):
    b = blocks(spark.createDataFrame([("f", _MIXED)], "plan_id string, explain_text string"))
    return b.select("block", "sql_text", F.size(F.split("explain_text", "\n")).alias("lines"))
