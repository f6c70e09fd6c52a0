"""Plans and events as streams: the batch functions applied to files as they come, with state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_stream(spark: SparkSession, folder: str) -> DataFrame:
    """plan_id, explain_text of text files as they arrive."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("plan_id"), F.col("value").alias("explain_text"))


def stream_findings(plans: DataFrame, write, checkpoint: str):
    """Starts a query that hands each batch's findings to write(findings, batch number): a plan is whole in its file, so batches need no state."""
    from plansmith.plans import parser, rules

    def batch(df: DataFrame, number: int) -> None:
        write(rules.findings(parser.parse(df)), number)

    return plans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_runtime(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by type and window of time; state goes once the watermark has passed a window."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def user_sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users that end after a gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
