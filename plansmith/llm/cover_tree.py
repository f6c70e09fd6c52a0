"""Near-duplicate vectors by cover trees and dual traversal.

Vectors of a label that are equal count as one. Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance t. Each
label's vectors fall into cells, each around the nearest of a bounded number of pivots, the top of the tree; cells split into blocks. A vector's
partners in another cell are no more than 2t nearer to that cell's pivot than it is to its own, so it goes, as a guest, to the cells of lower
number that are so near, and to no others. Where vectors meet, each side gets a cover tree (nested levels, halving radii, each node with its true
covering radius), and both trees are gone through together: a pair of nodes is dropped if its bound is over the threshold, taken whole if its
bound is under it, and split otherwise. Leaves are compared exactly.

A tree is built from the top: a node's vectors are compared with its children's centres only, each child taking what is near it from what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import cut, prepare, table
from plansmith.llm.components import components, forest_of

COSINE = 0.93
#: Vectors of a block (about), pivots of a label and of all labels at most, vectors of a leaf, safety of the bounds, parts of equal vectors' rows.
BLOCK, PIVOTS, ALL_PIVOTS, LEAF, SAFE, SALTS = 2048, 64, 1 << 14, 8, 1e-7, 8


@dataclass
class Node:
    centre: np.ndarray
    radius: float  #: the true covering radius
    members: np.ndarray
    children: list[Node]


def build(x: np.ndarray, members: np.ndarray | None = None, reach: float = 2.0, centre: int | None = None) -> Node:
    """The cover tree of unit vectors: children's centres are within ``reach`` of the node's and more than half of it apart."""
    members = np.arange(len(x)) if members is None else members
    centre = int(members[0]) if centre is None else centre
    own = x[members]
    far = _distance(own @ x[centre])
    node = Node(x[centre], float(far.max()) + SAFE, members, [])
    if len(members) <= LEAF or node.radius <= 4 * SAFE:
        return node
    while reach / 2 >= node.radius:
        reach /= 2
    free, at = np.ones(len(members), bool), int(np.flatnonzero(members == centre)[0])
    while True:  # nested: the node's centre is its first child's
        near = free & (own @ own[at] >= 1 - reach * reach / 8)  # at most reach / 2 apart
        near[at] = True
        node.children.append(build(x, members[near], reach / 2, int(members[at])))
        free &= ~near
        left = int(free.sum())
        if not left:
            return node
        if 2 * left < len(free):
            own, members, free = own[free], members[free], np.ones(left, bool)
        at = int(free.argmax())


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Links:
    """Sums of partners' weights and a forest of links between the vectors of two blocks (or within one)."""

    def __init__(self, x: np.ndarray, weights: np.ndarray, cosine: float):
        self.x, self.weights, self.cosine = x, weights, cosine
        self.threshold = float(np.sqrt(2 - 2 * cosine))
        self.count, self.pairs = np.zeros(len(x), np.int64), []

    def join(self, a: Node, b: Node) -> None:
        """All links between the members of two nodes; the same node: within it."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if not a.children and not b.children:
                self._exact(a.members, b.members, a is b)
                continue
            left, right = a.children or [a], b.children or [b]
            gap = _distance(np.stack([n.centre for n in left]) @ np.stack([n.centre for n in right]).T)
            reach = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None, :]
            near, whole = gap <= self.threshold + reach + SAFE, gap + reach < self.threshold - SAFE
            if a is b:
                near = np.triu(near)
            for i, j in np.argwhere(near & whole).tolist():
                self._whole(left[i].members, right[j].members, left[i] is right[j])
            stack.extend((left[i], right[j]) for i, j in np.argwhere(near & ~whole).tolist())

    def _whole(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        self.count[a] += self.weights[b].sum() - (self.weights[a] if same else 0)
        if not same:
            self.count[b] += self.weights[a].sum()
        every = np.union1d(a, b)
        self.pairs.extend((int(every[0]), v) for v in every[1:].tolist())

    def _exact(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        hit = self.x[a] @ self.x[b].T >= self.cosine
        if same:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        np.add.at(self.count, a[i], self.weights[b[j]])
        np.add.at(self.count, b[j], self.weights[a[i]])
        self.pairs.extend(zip(a[i].tolist(), b[j].tolist(), strict=True))


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow column of lists of one length, in double precision."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector: str, label: str):
    squares = f"aggregate({vector}, 0D, (t, x) -> t + cast(x as double) * cast(x as double))"
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return F.expr(f"coalesce({label} is not null and {vector} is not null and {finite} and {squares} > 0, false)")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """key, n_links (other rows of the same label at the cosine or over it), component_id (the smallest key reachable), kept (key = component_id).

    Null labels and vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different lengths
    neither. Repeated rows each count. Each row comes out once.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fine = rows.where(_usable("v", "label")).withColumn("group", F.struct("label", F.size("v").alias("size")))
    fine = fine.withColumn("name", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(5), "v").alias("b")))  # 128 bits for a vector
    same = cut(fine.groupBy("group", "v").agg(F.first("name").alias("name"), F.min("k").alias("rep"), F.count("*").alias("n")))
    wanted = same.groupBy("group").agg(F.count("*").alias("n")).withColumn("cells", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK)))
    share = same.join(wanted.select("group", "cells", F.col("n").alias("all")), "group")
    sampled = share.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(1 << 30) * F.col("cells") / F.col("all"))
    pivots: dict = {}
    for r in sampled.select("group", "v").orderBy(F.xxhash64("v")).limit(ALL_PIVOTS).collect():
        pivots.setdefault(tuple(r["group"]), []).append(np.array(r["v"], np.float64))
    pivots = {g: (p := np.stack(v)) / np.sqrt((p * p).sum(1, keepdims=True)) for g, v in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)  # at most ALL_PIVOTS vectors
    reach = 2 * float(np.sqrt(2 - 2 * cosine)) + SAFE

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            groups = [tuple(g.values()) for g in batch.column(0).to_pylist()]
            cell, guest = np.zeros(len(groups), np.int64), [[]] * len(groups)
            for g in set(groups):
                if (p := shared.value.get(g)) is not None:
                    at = np.array([i for i, x in enumerate(groups) if x == g])
                    gap = _distance(_matrix(batch.column(1).take(pa.array(at))) @ p.T)
                    cell[at] = gap.argmin(1)
                    for i, near in zip(at.tolist(), gap <= gap.min(1, keepdims=True) + reach, strict=True):
                        guest[i] = np.flatnonzero(near[: cell[i]]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(guest, pa.list_(pa.int64()))], [*columns, "cell", "guest"])

    columns = ["group", "v", "rep", "n"]
    fields = ", ".join(f"`{c}` {same.schema[c].dataType.simpleString()}" for c in columns)
    placed = cut(same.select(*columns).mapInArrow(place, fields + ", cell bigint, guest array<bigint>"))
    guests = placed.select("group", F.explode("guest").alias("cell"), "rep", "n", "v")
    size = lambda n: F.ceil(F.count("*") / BLOCK).cast("int").alias(n)
    cells = placed.groupBy("group", "cell").agg(size("blocks")).join(guests.groupBy("group", "cell").agg(size("guests")), ["group", "cell"], "left")
    cells = cut(cells.select("group", "cell", "blocks", F.coalesce("guests", F.lit(0)).alias("guests")))
    mine = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    # a meeting: hosts of blocks a and b, or (kind 1) hosts of block a and guests of block b
    hosts = placed.select("group", "cell", "rep", "n", "v").join(cells, ["group", "cell"]).withColumn("own", mine(3, "blocks"))
    own, other = F.col("own"), F.col("other")
    pairs = hosts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("group", "cell", F.lit(0).alias("kind"), F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), (own > other).alias("second"), "rep", "n", "v")
    open_ = hosts.where("guests > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("other")).select("group", "cell", F.lit(1).alias("kind"), own.alias("a"), other.alias("b"), F.lit(False).alias("second"), "rep", "n", "v")
    come = guests.join(cells, ["group", "cell"]).withColumn("own", mine(5, "guests")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    come = come.select("group", "cell", F.lit(1).alias("kind"), other.alias("a"), own.alias("b"), F.lit(True).alias("second"), "rep", "n", "v")
    dealt = pairs.union(open_).union(come).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group", "cell", "kind", "a", "b")  # meetings are small but long
    found = cut(dealt.groupBy("group", "cell", "kind", "a", "b").applyInArrow(_meet(cosine), "rep bigint, links bigint, root bigint"))
    added = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root").withColumnRenamed("node", "rep")
    classes = same.join(added, "rep", "left").join(roots, "rep", "left").select("group", "name", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # equal vectors may be a third of all rows: what is known of them goes to SALTS tasks
    salted = classes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    linked = fine.select("group", "name", "k").withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS))).join(salted, ["group", "name", "salt"]).select("k", "n_links", "component_id")
    alone = rows.where(~_usable("v", "label")).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionByName(alone).select(F.col("k").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("k") == F.col("component_id")).alias("kept"))


def _meet(cosine: float):
    def run(_, rows):
        import pyarrow as pa

        second = np.asarray(rows["second"])
        rep, weights = np.asarray(rows["rep"]), np.asarray(rows["n"])
        x = _matrix(rows["v"])
        links = Links(x, weights, cosine)
        first, other = np.flatnonzero(~second), np.flatnonzero(second)
        if rows["kind"][0].as_py() == 0 and rows["a"][0] == rows["b"][0]:
            tree = build(x)
            links.join(tree, tree)
        elif len(first) and len(other):
            links.join(build(x, first), build(x, other))
        root = forest_of(sorted({(int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))) for i, j in links.pairs}))
        at = np.flatnonzero(links.count)
        return pa.table({"rep": rep[at], "links": links.count[at], "root": np.array([root[int(r)] for r in rep[at]], np.int64)})

    return run


def op8_cover_tree(spark, sf_dir: str) -> DataFrame:
    """Vectors of the same label at a cosine of 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT * FROM e WHERE list_dot_product(v, v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT a AS node, b AS root FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.root = p.a)
SELECT vec_id, CAST((SELECT count(*) FROM p WHERE p.a = embeddings.vec_id) AS BIGINT) AS n_links,
       least(vec_id, coalesce((SELECT min(root) FROM r WHERE r.node = embeddings.vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(root) FROM r WHERE r.node = embeddings.vec_id), vec_id)) AS kept
FROM embeddings
"""
