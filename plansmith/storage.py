"""Where queries that write tables put them: the folder that a cluster's driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table, with its file system: in ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="plansmith-")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
