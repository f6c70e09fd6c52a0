"""Complexity of procedural blocks: loops, cursors, dynamic statements, transactions, calls."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.registry import query

_TOKEN = re.compile(r"/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'|[A-Za-z_][\w$]*|\d+|:=|[^\s\w]", re.S)
COUNTERS = ["loops", "loop_depth", "cursors", "cursor_ops", "dynamic", "using_args", "transactions", "statements", "ifs"]
#: Tags: name and the least count that a counter must be over (fixed values).
TAGS = {"deep loops": ("loop_depth", 2), "dynamic SQL": ("dynamic", 0), "many cursors": ("cursors", 3), "transaction control": ("transactions", 0)}


def count(block: str | None) -> dict[str, int]:
    """Counters of one block; a null or empty text has none. What is in quotes or comments doesn't count."""
    out = dict.fromkeys(COUNTERS, 0)
    up = [t.upper() for t in _TOKEN.findall(block or "") if not t.startswith(("/*", "--"))]
    depth = 0
    for i, t in enumerate(up):
        before, after = up[i - 1] if i else "", up[i + 1] if i + 1 < len(up) else ""
        if t == "LOOP":
            if before == "END":
                depth -= 1
            else:
                depth += 1
                out["loops"] += 1
                out["loop_depth"] = max(out["loop_depth"], depth)
        elif t == "CURSOR" and before != "REF":
            out["cursors"] += 1
        elif t in ("OPEN", "FETCH", "CLOSE"):
            out["cursor_ops"] += 1
        elif t == "EXECUTE":
            out["dynamic"] += 1
        elif t == "USING" and "EXECUTE" in up[max(0, i - 12) : i]:
            end = next((k for k in range(i, len(up)) if up[k] == ";"), len(up))
            out["using_args"] += up[i:end].count(",") + 1
        elif t in ("COMMIT", "ROLLBACK", "SAVEPOINT"):
            out["transactions"] += 1
        elif t in ("SELECT", "INSERT", "DELETE", "MERGE") or (t == "UPDATE" and before not in ("FOR", "ON")):
            out["statements"] += 1
        elif t == "IF" and before != "END":
            out["ifs"] += 1
    return out


def dynamic_score(length, tables, hints):
    """Of a statement that is put together at run time, from its length, tables and hints: columns or numbers."""
    if isinstance(length, (int, float)):
        return float(np.trunc(np.log10(max(length, 1)) * 5 * (1 + 0.1 * tables)) + 3 * hints)
    return F.floor(F.log10(F.greatest(length, F.lit(1))) * 5 * (1 + 0.1 * tables)).cast("double") + 3 * hints


def counters(df: DataFrame, block: str) -> DataFrame:
    """Adds the counters and the tags of a column of blocks."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [count(x) for x in b.column(names.index(block)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([m[c] for m in made], pa.int32()) for c in COUNTERS]], [*names, *COUNTERS])

    out = df.mapInArrow(run, ", ".join([*fields, *[f"`{c}` int" for c in COUNTERS]]))
    return out.withColumn("tags", F.filter(F.array(*[F.when(F.col(c) > n, F.lit(t)) for t, (c, n) in TAGS.items()]), lambda x: x.isNotNull()))


_BLOCK = """DECLARE CURSOR c IS SELECT a FROM t; BEGIN OPEN c; LOOP FETCH c INTO x; EXIT WHEN c%NOTFOUND;
 FOR i IN 1..3 LOOP EXECUTE IMMEDIATE 'UPDATE u SET a = :1, b = :2 WHERE k = 1' USING x, i; END LOOP; -- LOOP
 END LOOP; CLOSE c; IF x > 0 THEN COMMIT; END IF; END;"""


@query("SELECT 1 AS block_id, 2 AS loops, 2 AS loop_depth, 1 AS cursors, 3 AS cursor_ops, 1 AS dynamic, 2 AS using_args, 1 AS transactions, 1 AS statements, 1 AS ifs, 'dynamic SQL;transaction control' AS tags")
def complexity_procedure(spark, sf_dir):
    rows = counters(spark.createDataFrame([(1, _BLOCK)], "block_id int, block string"), "block")
    return rows.drop("block").withColumn("tags", F.array_join("tags", ";"))


@query("SELECT * FROM (VALUES (100, 1, 0, 11.0), (1000, 2, 1, 21.0)) AS t(length, tables, hints, score)")
def complexity_dynamic(spark, sf_dir):
    rows = spark.createDataFrame([(100, 1, 0), (1000, 2, 1)], "length int, tables int, hints int")
    return rows.withColumn("score", dynamic_score(F.col("length"), F.col("tables"), F.col("hints")))
