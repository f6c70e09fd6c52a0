"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch holds; texts may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 4096, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches for this session from here on (results are computed when they are read), and a checkpoint folder if none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), with its file system; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plansmith-"))
    path = sc._jvm.org.apache.hadoop.fs.Path(named or sc._jsc.sc().getCheckpointDir().get())
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def carried(df: DataFrame, keep, added: list[str]):
    """(a column ``row`` that holds the kept columns apart from the operator's own, what puts them before the new columns of a result).

    A kept column that has the name of a new one is replaced by it.
    """
    new = {a.lower() for a in added}
    keep = [c for c in keep if c.lower() not in new]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.lit(0)
    return row.alias("row"), lambda out: out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"`{a}`") for a in added])


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine: workers stay for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_pieces(batches, column: int, most: int):
    """Splits record batches so that the strings of one column come to about ``most`` bytes a piece (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


def gathered(batches, column: int, most: int):
    """Joins record batches until the strings of one column come to about ``most`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
