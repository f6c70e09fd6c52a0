"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` ids. Piece lengths are whole numbers from 1 to the capacity, so a histogram of bounded size
stands for any number of pieces, and the driver plans on it alone:

1. Lengths over ``small`` of the capacity are large. In order of size they form groups of equal cardinality; each counts as its group's longest.
2. The linear program over configurations (which groups share a sequence) is solved by column generation; its whole part is used.
3. Actual lengths take the slots of their group, longest first. What the rounding has left over goes best-fit.
4. Small lengths go best-fit, longest first, into the gaps.

All steps work on runs (this many sequences of the same content), whose number depends on the capacity and not on the corpus. Pieces find
their place by their rank among pieces of the same length; ranks are partition bases from prefix sums plus places within a partition.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansmith.llm.common import cut, in_pieces, prepare, table

#: Ids in a sequence, the share of it up to which a length is small, groups of large lengths, and pivots of the linear program at most.
CAPACITY, SMALL, GROUPS, PIVOTS = 2048, 1 / 8, 96, 4000
#: The id after each document.
END_ID = 0
BYTES = 2 << 20


def pieces(df: DataFrame, file: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and the end id; the first piece takes what doesn't fill whole sequences.

    Null text counts as empty (one id). Columns: key, piece, start, length, ids_crc32, ids (if asked for), part and place (the piece's number
    among those of the same length in the same partition).
    """
    prepare(df.sparkSession)
    frame = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from plansmith.llm.byte_bpe import encoder

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in in_pieces(batches, 1, BYTES):
            ids, counts = encoder(file).encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts + 1)
            all_ids = np.full(int(ends[-1]), END_ID, "<u4")
            inside = np.ones(len(all_ids), bool)
            inside[ends - 1] = False
            all_ids[inside] = ids
            n = counts + 1
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = (n - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            at = (ends - n)[row] + start
            data = memoryview(all_ids.tobytes())
            cuts = [data[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, first, size = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.repeat(first, size) + np.repeat(seen[kinds], size)
            seen[kinds] += size
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
            columns += [pa.array([bytes(c) for c in cuts], pa.binary())] if with_ids else []
            names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "part", "place"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), part), pa.int32()), pa.array(place)], names)

    kind = frame.schema.fields[0].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, {'ids binary, ' if with_ids else ''}part int, place bigint")


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear program's configurations (how many of each size) and how often each is used."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(wanted, float)
    basis = [np.eye(k)[i] * (capacity // size[i]) for i in range(k)]
    inverse = np.diag([1 / b[i] for i, b in enumerate(basis)])
    layers = capacity // int(size.min())
    room = np.arange(capacity + 1)[:, None] - size[None, :]
    fits, below = room >= 0, np.maximum(room, 0)
    for _ in range(PIVOTS):
        price = inverse.sum(0)  # every configuration costs one sequence
        best, picks = np.zeros(capacity + 1), []
        for _layer in range(layers):
            value = np.where(fits, best[below] + price[None, :], -1.0)
            pick = value.argmax(1)
            new = np.maximum(value[np.arange(capacity + 1), pick], best)
            picks.append(np.where(new > best + 1e-12, pick, -1))
            if np.allclose(new, best, atol=1e-12):
                break
            best = new
        column, left = np.zeros(k), capacity
        for pick in reversed(picks):
            if (i := int(pick[left])) >= 0:
                column[i] += 1
                left -= sizes[i]
        if column @ price <= 1 + 1e-7:
            break
        direction, level = inverse @ column, inverse @ need
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return list(zip(basis, np.maximum(inverse @ need, 0), strict=True))


class Runs:
    """Sequences of the same content, by the room that they have left: lists of [how many, {length: copies} in order, room]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            self.by_room[self.capacity - sum(a * b for a, b in content)].append((n, content))

    def best_fit(self, length: int, m: int) -> None:
        """Puts m pieces of one length where they leave least room; opens sequences for the rest."""
        for room in sorted(r for r in self.by_room if r >= length):
            each, runs = room // length, self.by_room.pop(room)
            while runs and m:
                n, content = runs.pop()
                full = min(n, m // each)
                self.add(full, [*content, (length, each)])
                m -= full * each
                if full < n and m:
                    self.add(1, [*content, (length, m)])
                    full, m = full + 1, 0
                if full < n:
                    runs.append((n - full, content))
            if runs:
                self.by_room[room].extend(runs)
            if not m:
                return
        each = self.capacity // length
        self.add(m // each, [(length, each)])
        if m % each:
            self.add(1, [(length, m % each)])


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, sequences, copies, first sequence, offset), sorted: where the pieces of each length go.

    Pieces of a length have ranks from 0; those of a row fill copy after copy of the row's sequences.
    """
    runs = Runs(capacity)
    left = dict(histogram)
    runs.add(left.pop(capacity, 0), [(capacity, 1)])
    large = sorted((x for x in left if x > small * capacity), reverse=True)
    total = sum(left[x] for x in large)
    if total:
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group [length, how many], longest first
        have = 0
        for x in large:
            n = left[x]
            while n:
                if have == each:
                    members.append([])
                    have = 0
                take = min(n, each - have)
                members[-1].append([x, take])
                have, n = have + take, n - take
        tops = sorted({g[0][0] for g in members}, reverse=True)  # groups of the same longest length count as one
        merged = [[m for g in members if g[0][0] == t for m in g] for t in tops]
        for config, often in configurations(tops, [sum(n for _, n in g) for g in merged], capacity):
            copies = config.astype(int)
            times = min([int(often + 1e-6), *(sum(n for _, n in merged[i]) // c for i, c in enumerate(copies) if c)])
            if times > 0 and copies.any():
                _fill(runs, merged, copies, times)
        for x, n in [m for g in merged for m in g]:
            if n:
                runs.best_fit(x, n)
    for x in sorted((x for x in left if x <= small * capacity), reverse=True):
        runs.best_fit(x, left[x])
    return _places(runs)


def _fill(runs: Runs, merged, copies, times: int) -> None:
    """Takes the longest members of each slot's group for so many sequences of one configuration."""
    slots = []
    for i, c in enumerate(copies):
        for _ in range(c):
            steps, need = [], times
            for m in merged[i]:
                take = min(m[1], need)
                if take:
                    steps.append((m[0], take))
                    m[1], need = m[1] - take, need - take
            merged[i] = [m for m in merged[i] if m[1]]
            slots.append(steps)
    edges = sorted({0, times, *(int(e) for s in slots for e in np.cumsum([n for _, n in s]))})
    at = [[int(e) for e in np.cumsum([n for _, n in s])] for s in slots]
    for a, b in zip(edges, edges[1:], strict=False):
        content: dict[int, int] = defaultdict(int)
        for s, ends in zip(slots, at, strict=True):
            content[s[int(np.searchsorted(ends, a, "right"))][0]] += 1
        runs.add(b - a, sorted(content.items(), reverse=True))


def _places(runs: Runs) -> np.ndarray:
    rows, ranks, sequence = [], defaultdict(int), 0
    for room in sorted(runs.by_room):
        for n, content in runs.by_room[room]:
            offset = 0
            for length, copies in content:
                rows.append((length, ranks[length], n, copies, sequence, offset))
                ranks[length] += n * copies
                offset += length * copies
            sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that is read more than once (see ``pieces`` and ``cut``)."""
    sizes = cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    rows = plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, **options)  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", "length", before.alias("base"))
    ranked = cut_pieces.join(bases, ["part", "length"]).withColumn("place", F.col("base") + F.col("place")).drop("base", "part")
    where = ranked.columns.index("length"), ranked.columns.index("place")

    def run(batches):
        import pyarrow as pa

        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in where)
            found = rows[np.searchsorted(keys, length << 48 | rank, "right") - 1] if len(length) else np.empty((0, 6), np.int64)
            copy, number = np.divmod(rank - found[:, 1], np.maximum(found[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[:, 4] + number), pa.array(found[:, 5] + copy * length)], [*names, "sequence_id", "offset"])

    names = ranked.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"])).drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, ids as little-endian unsigned 32-bit integers) of pieces packed with ids; groups are bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents (null text: empty), with an end id each, in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(cut(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))))
