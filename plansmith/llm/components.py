"""Connected components of a table of links.

Each partition first replaces its links by spanning forests (union-find over LINKS links at a time). Then large-star and small-star
steps, which are joins and minima, run to a fixed point: every node ends next to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import cut


def forest_of(pairs) -> dict:
    """Union-find: each node's smallest reachable node."""
    root: dict = {}

    def find(x):
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != x:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
        root.setdefault(min(a, b), min(a, b))
    return {x: find(x) for x in root}


#: Links of which a task makes one forest.
LINKS = 1 << 18


def _contract(batches):
    import pyarrow as pa

    pairs: list = []

    def forest():
        found = [(x, r) for x, r in forest_of(pairs).items() if x != r]
        pairs.clear()
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])

    for batch in batches:
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(pairs) >= LINKS:
            yield from forest()
    yield from forest()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; a root is its component's smallest node. Nulls and links to oneself don't count."""
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = cut(edges.mapInArrow(_contract, "u bigint, v bigint"))
    if not edges.head(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state, most = None, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        edges = cut(_small(_large(edges)).coalesce(most))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
