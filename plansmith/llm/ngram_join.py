"""N-gram Jaccard join by T-occurrence search with the DivideSkip split into short and long lists.

A document's set holds the hashes of its distinct word shingles. Every shingle has an inverted list of the sets that hold it; a partner of a set
of n shingles must occur on at least T of its n lists, T = ceil(t n) or more for a threshold t. All sets order their lists alike, short ones
first: by hash, those that a count of the whole corpus calls frequent last. DivideSkip sets the longest T - l lists aside; a partner occurs on at
least l of the n - T + l short ones that are left, l growing with n.

1. Merging. Postings of short lists meet by shingle. Each list, sorted by size, tells every set its partners of like sizes; the runs that a task
   tells one set are added up before they are sent. Each set merges its runs in a heap and keeps partners that occur at least l times.
2. Probing. Pairs that differ in too many bits of their sketches can't be links. For the others the set's shingles, the long lists' too, are
   looked up by binary search among the partner's sorted ones. Pairs with the overlap that the threshold needs are links.

A large group of near copies would meet on each of its lists. So sets first ask one partner only, the leader of each of their 4 min-hash lists
(probed the same way); the merge leaves out pairs that are connected by then. That drops no link that matters to the components.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import cut, in_pieces, prepare, release, table
from plansmith.llm.components import components
from plansmith.llm.pretokens import mixed, span_hashes

WORDS, SIMILAR = 4, 85
BYTES = 1 << 19
#: A set merges one list more than it must for so many shingles, and asks for one occurrence more.
MORE = 32
#: A shingle is frequent if its counters are over this and four times their mean; bits of a counter's place; counters that are added up together.
FREQUENT, SLOT_BITS, BLOCK = 64, 22, 1 << 16
#: Min-hash leaders of each set; bits of the map (one 8 MB array) of sets to be probed.
LEADERS, MAP_BITS = 4, 26
#: Pairs that a list gives at once; members of lists that are gone through together; pairs that a task adds up at once.
PAIRS, SHORT, HELD = 1 << 18, 16, 1 << 20
#: Probes of one set in one task; parts of a hot set's or component's rows.
PROBES, SALTS = 4096, 8
#: A-Z to a-z, white space (0x20, 0x09-0x0D) to blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text in a row, and how many each has; fewer words than a shingle's are one shingle."""
    raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = data == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    edges = np.searchsorted(start, begins)
    word = span_hashes(data, start, end)
    n = np.diff(edges)
    with np.errstate(over="ignore"):
        mult = np.uint64(0x9E3779B97F4A7C15)
        rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * mult + word[k : k + len(rolled)]
        rolled = mixed(rolled + np.uint64(words))
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(n):
            a, b = edges[i], edges[i + 1]
            if n[i] >= words:
                found = np.unique(rolled[a : b - words + 1])
            else:
                h = np.uint64(0)
                for w in word[a:b]:
                    h = h * mult + w
                found = mixed(np.array([h + np.uint64(n[i])]))
            parts.append(found)
            sizes[i] = len(found)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


def fingerprints(tokens: np.ndarray, sizes: np.ndarray, seeds: int) -> list[np.ndarray]:
    """Of each set: one that stands for the whole set, then min-hashes. Empty sets get 0."""
    begin, some = (np.cumsum(sizes) - sizes)[sizes > 0], sizes > 0
    out = []
    with np.errstate(over="ignore"):
        for s in range(seeds + 1):
            column = np.zeros(len(sizes), np.uint64)
            if some.any():
                h = mixed(tokens + np.uint64(s) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
                column[some] = (np.add if s == 0 else np.minimum).reduceat(h, begin)
            out.append((mixed(column + sizes.astype(np.uint64)) if s == 0 else column).view(np.int64))
    return out


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Bit maps of sets, of the least power of two over two bits a shingle (64 at least): each shingle turns over one bit. Two sets differ in at
    least as many shingles as their maps in bits; a map's halves, one turned over by the other, are the map of half the size."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    at = np.repeat(base, sizes) + ((tokens >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, sizes))
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.split(np.packbits(odd).view(np.int64), base[1:] // 64)


def needed(x, y, similar: int):
    """The least overlap of sets of x and y with 100 * overlap >= similar * union."""
    return -(-similar * (x + y) // (100 + similar))


def occurrences(n, similar: int):
    """l: how often a partner must occur on the short lists of a set of n, at least."""
    return np.minimum(1 + n // MORE, -(-similar * n // 100))


def short_lists(n, similar: int):
    """n - T + l for the least T = ceil(similar n / 100) that any partner needs."""
    return n - -(-similar * n // 100) + occurrences(n, similar)


def bands(similar: int, most: int = 1 << 40) -> np.ndarray:
    """Sizes at which bands begin; partners are of one band or of neighbouring ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(100 * edges[-1] // similar + 1)
    return np.array(edges, np.int64)


def _texts(df: DataFrame, text: str, *more: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), *more)


def _summaries(df: DataFrame, key: str, text: str, words: int, frequent: np.ndarray) -> DataFrame:
    """key, n, set (fingerprint of the set), m0.. (min-hashes), sketch, rare (per mille of shingles that aren't frequent), at (hash of the text)
    of each row."""
    frame = _texts(df, text, F.col(key).alias("key")).withColumn("at", F.xxhash64("__text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # of a fixed size

    def run(batches):
        import pyarrow as pa

        for batch in in_pieces(batches, 0, BYTES):
            tokens, sizes = shingles(batch.column(0).to_pylist(), words)
            marks = fingerprints(tokens, sizes, LEADERS)
            rare = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~_is_frequent(tokens, shared.value), len(sizes)) * 1000 // np.maximum(sizes, 1)
            sketch = pa.array(sketches(tokens, sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), *map(pa.array, marks), sketch, pa.array(rare.astype(np.int64)), batch.column(2)], ["key", "n", "set", *names, "sketch", "rare", "at"])

    names = [f"m{k}" for k in range(LEADERS)]
    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"key {kind}, n bigint, set bigint, " + ", ".join(f"{m} bigint" for m in names) + ", sketch array<bigint>, rare bigint, at bigint")


def _slots(tokens: np.ndarray) -> list[np.ndarray]:
    """A shingle's counter in each row of the sketch."""
    return [(tokens >> np.uint64(shift)).astype(np.int64) & ((1 << SLOT_BITS) - 1) for shift in (2, 38)]


def _frequent(df: DataFrame, text: str, words: int) -> np.ndarray:
    """Which counters of a count-min sketch of all shingles of all documents are high: 2 rows of bits, of a fixed size.

    A shingle is frequent if both its counters are. That decides on the order of lists alone, the same for all documents: any order gives the
    same links.
    """

    def run(batches):
        import pyarrow as pa

        counters, held = np.zeros((2, 1 << SLOT_BITS), np.int32), []

        def count():
            tokens = np.concatenate(held)
            held.clear()
            for row, slots in enumerate(_slots(tokens)):
                counters[row] += np.bincount(slots, minlength=1 << SLOT_BITS).astype(np.int32)

        for batch in in_pieces(batches, 0, BYTES):
            held.append(shingles(batch.column(0).to_pylist(), words)[0])
            if sum(map(len, held)) > HELD:
                count()
        if held:
            count()
        if counters.any():
            for at, part in enumerate(counters.reshape(-1, BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["block", "n"])

    def add(key, rows):
        import pyarrow as pa

        total = np.zeros(BLOCK, np.int64)
        for x in rows["n"].to_pylist():
            total += np.frombuffer(pa.decompress(x, BLOCK * 4, codec="zstd", asbytes=True), np.int32)
        high = np.packbits(total > FREQUENT + 4 * total.mean())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([high.tobytes()], pa.binary())})

    told = _texts(df, text).mapInArrow(run, "block int, n binary").groupBy("block").applyInArrow(add, "block int, bits binary")
    out = np.zeros((2 << SLOT_BITS) // 8, np.uint8)
    for r in told.collect():  # as many rows as the sketch has blocks
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(2, -1)


def _is_frequent(tokens: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.ones(len(tokens), bool)
    for bits, slots in zip(high, _slots(tokens), strict=True):
        out &= (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _orders(df: DataFrame, text: str, words: int, similar: int, frequent: np.ndarray) -> DataFrame:
    """set, n, late, lists: a row for each different set with shingles, with the shingles of its short lists in order, as bytes, of which the
    last ``late`` are frequent."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # of a fixed size

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in in_pieces(batches, 0, BYTES):
            tokens, sizes = shingles(batch.column(0).to_pylist(), words)
            (mark,) = fingerprints(tokens, sizes, 0)
            late = _is_frequent(tokens, shared.value)
            ends, most = np.cumsum(sizes), short_lists(sizes, similar)
            rows = []
            for i, m in enumerate(mark.tolist()):
                if sizes[i] and m not in seen:
                    seen.add(m)
                    own, last = tokens[ends[i] - sizes[i] : ends[i]], late[ends[i] - sizes[i] : ends[i]]
                    rows.append((m, int(sizes[i]), max(0, int(most[i] - (~last).sum())), np.concatenate([own[~last], own[last]])[: most[i]].tobytes()))
            if len(seen) > HELD:  # copies that are missed here meet by set
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["set", "n", "late", "lists"])

    told = _texts(df, text).mapInArrow(run, "set bigint, n bigint, late bigint, lists binary")
    return told.groupBy("set").agg(F.first("n").alias("n"), F.first("late").alias("late"), F.first("lists").alias("lists"))


def _postings(similar: int):
    """Rows (token, band, set, n, root, place): a frequent shingle's list is split by size, and each set is on the next band's part too, as a
    guest (band < 0 marks it); other lists stay whole, in band 0."""
    edges = bands(similar)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                size = np.array([len(x) for x in lists])
                if not size.sum():
                    continue
                row = np.repeat(np.arange(len(lists)), size)
                names, n, late, root = (np.asarray(part.column(i))[row] for i in (0, 1, 2, 4))
                place = np.concatenate([np.arange(s) for s in size])
                hot = place >= size[row] - late
                band = np.where(hot, np.searchsorted(edges, n, "right"), 0)
                own = [np.concatenate(lists), band, band, names, n, root, place]
                columns = [np.concatenate([x, x[hot] + (i == 1)]) for i, x in enumerate(own)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], POSTING)

    return run


POSTING = ["token", "part", "band", "set", "n", "root", "place"]


def merge(sets, n, roots, places, band, part, similar: int):
    """(query, its n, partner) of one inverted list, block by block: sets of like sizes that aren't connected yet and may overlap enough.

    Sorted by size, a set's partners are the members from its own place up to the last size that allows the similarity.
    """
    order = np.lexsort((sets, n))
    new = np.append(True, np.diff(sets[order]) != 0)  # copies of a set that came in twice
    order = order[new]
    sets, n, roots, places, guest = sets[order], n[order], roots[order], places[order], band[order] != part
    last = np.searchsorted(n, 100 * n // similar, "right")
    at = np.arange(len(n))
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(np.cumsum(last[i:] - at[i:]), PAIRS, "right")) + i)
        many = last[i:j] - at[i:j] - 1
        x = np.repeat(at[i:j], many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + x + 1
        spare = occurrences(n[x], similar) - 1  # the first l common shingles leave at least the others behind them
        good = (roots[x] != roots[y]) & ~(guest[x] & guest[y]) & (np.minimum(n[x] - places[x], n[y] - places[y]) >= needed(n[x], n[y], similar) - spare)
        x, y = x[good], y[good]
        if len(x):
            yield sets[x], n[x], sets[y]
        i = j


def merge_short(number, sets, n, roots, places, band, part, similar: int):
    """The same of many lists of up to SHORT members at once; number: of the list, ascending."""
    for k in range(1, SHORT):
        x = np.flatnonzero(number[k:] == number[:-k])
        if not len(x):
            return
        x = x[roots[x] != roots[x + k]]
        y = x + k
        swap = (n[x] > n[y]) | ((n[x] == n[y]) & (sets[x] > sets[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        spare = occurrences(n[x], similar) - 1
        good = (100 * n[x] >= similar * n[y]) & ((band[x] == part[x]) | (band[y] == part[y])) & (np.minimum(n[x] - places[x], n[y] - places[y]) >= needed(n[x], n[y], similar) - spare)
        if good.any():
            yield sets[x[good]], n[x[good]], sets[y[good]]


def _told(similar: int):
    """Goes through lists in order of shingle, each whole in one partition; tells each set its partners with their occurrences, sorted."""

    def run(batches):
        import pyarrow as pa

        found: list = []
        held: list[np.ndarray] | None = None

        def emit(least):
            if not found or sum(len(x[0]) for x in found) <= least:
                return
            query, n, partner = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((partner, query))
            query, n, partner = query[order], n[order], partner[order]
            pair = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (partner[1:] != partner[:-1])))
            times = np.diff(np.append(pair, len(query)))
            query, n, partner = query[pair], n[pair], partner[pair]
            edge = np.append(np.flatnonzero(np.append(True, query[1:] != query[:-1])), len(query))
            for a in range(0, len(edge) - 1, 10_000):
                e = edge[a : a + 10_001]
                offsets = pa.array(e - e[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[e[0] : e[-1]])) for x in (partner, times)]
                yield pa.RecordBatch.from_arrays([pa.array(query[e[:-1]]), pa.array(n[e[:-1]]), *lists], ["query", "n", "partners", "times"])

        def lists(columns, final):
            nonlocal held
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            held = None
            new = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            edges = np.flatnonzero(np.append(True, new)) if len(columns[0]) else np.empty(0, int)
            ends = np.append(edges[1:], len(columns[0]))
            if not final and len(edges):
                held = [c[edges[-1] :] for c in columns]
                edges, ends = edges[:-1], ends[:-1]
            size = ends - edges
            row = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size)) + (edges[0] if len(edges) else 0)
            number = np.repeat(np.arange(len(size)), size)[row - (edges[0] if len(edges) else 0)]
            _, part, band, sets, n, roots, places = (c[row] for c in columns)
            for some in merge_short(number, sets, n, roots, places, band, part, similar):
                found.append(some)
                yield from emit(HELD)
            for a, b in zip(edges[size > SHORT].tolist(), ends[size > SHORT].tolist(), strict=True):
                _, part, band, sets, n, roots, places = (c[a:b] for c in columns)
                if roots.min() != roots.max():
                    for some in merge(sets, n, roots, places, band, part, similar):
                        found.append(some)
                        yield from emit(HELD)

        for batch in batches:
            if batch.num_rows:
                yield from lists([np.asarray(c) for c in batch.columns], False)
        if held is not None:
            yield from lists([c[:0] for c in held], True)
        yield from emit(0)
        release()

    return run


def heap_merge(runs: list[tuple[list, list]], least: int) -> list:
    """The partners that occur at least so often in sorted runs of (partners, occurrences)."""
    merged = heapq.merge(*(zip(p, t, strict=True) for p, t in runs))
    return [p for p, own in groupby(merged, lambda x: x[0]) if sum(t for _, t in own) >= least]


def _occurring(similar: int):
    """Merges each query's runs, which come one after another; emits (a, b): a query and a partner with enough occurrences."""

    def run(batches):
        import pyarrow as pa

        now, size, runs = None, 0, []
        for batch in batches:
            a, b = [], []
            for query, n, partners, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if query != now:
                    got = heap_merge(runs, int(occurrences(size, similar)))
                    a += [now] * len(got)
                    b += got
                    now, size, runs = query, n, []
                runs.append((partners, times))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        got = heap_merge(runs, int(occurrences(size, similar)))
        yield pa.RecordBatch.from_arrays([pa.array([now] * len(got), pa.int64()), pa.array(got, pa.int64())], ["a", "b"])

    return run


def _bit_map(names: DataFrame) -> np.ndarray:
    """A fixed number of bits; those of the 64-bit names in the table's one column are set."""

    def bits(batches):
        import pyarrow as pa

        own = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for batch in batches:
            slot = mixed(np.asarray(batch.column(0)).view(np.uint64)) >> np.uint64(64 - MAP_BITS)
            np.bitwise_or.at(own, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(own)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(own[at[k : k + 100_000]], pa.int32())], ["at", "bits"])

    rows = names.mapInArrow(bits, "at bigint, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most 2 ** (MAP_BITS - 3) rows
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return out


def _probed(df: DataFrame, text: str, words: int, similar: int, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: sets) that overlap enough, by binary search of a's shingles among b's.

    pairs must be cut. Only sets that a fixed-size bit map of the pairs lets through are sent, as sorted shingles; a set of many pairs is sent
    to several tasks.
    """
    used = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("set"))
    shared = df.sparkSession.sparkContext.broadcast(_bit_map(sets.join(used, "set").select("at")))  # of a fixed size

    def send(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in in_pieces(batches, 0, BYTES):
            names = np.asarray(batch.column(1))
            slot = mixed(names.view(np.uint64)) >> np.uint64(64 - MAP_BITS)
            hit = (shared.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            fresh = []
            for i in np.flatnonzero(hit).tolist():
                if (m := int(names[i])) not in seen:
                    seen.add(m)
                    fresh.append(i)
            tokens, sizes = shingles(batch.column(0).take(pa.array(fresh, pa.int64())).to_pylist(), words)
            (mark,) = fingerprints(tokens, sizes, 0)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array([tokens[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())], ["set", "tokens"])

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                own, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                found = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
                keep.append(bool(found.sum() >= needed(len(own), len(other), similar)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    frame = _texts(df, text).select("__text", F.xxhash64("__text").alias("at"))
    tokens = frame.mapInArrow(send, "set bigint, tokens binary").groupBy("set").agg(F.first("tokens").alias("tokens"))
    asked = pairs.groupBy("a").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("salts"))
    own = tokens.withColumnRenamed("set", "a").join(asked.hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("tokens").alias("ta"))
    dealt = pairs.join(asked, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    # both sides sorted: the same way at every size
    with_a = dealt.join(own.hint("merge"), ["a", "salt"]).select("a", "b", "ta")
    return with_a.join(tokens.select(F.col("set").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(probe, "a bigint, b bigint")


def _possible(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    half = "if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    apart = F.expr(f"aggregate(zip_with({half.format(x='sa', y='sb')}, {half.format(x='sb', y='sa')}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    least = F.expr(f"({similar} * (na + nb) + {99 + similar}) div {100 + similar}")
    close = F.least("na", "nb") * 100 >= similar * F.greatest("na", "nb")
    return pairs.where(close).where(apart <= F.col("na") + F.col("nb") - 2 * least).select("a", "b")


def _led(sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of min-hash leaders, the members with the fewest rare shingles, and the members of their groups."""
    mine = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(LEADERS)])
    marks = sets.select("set", "n", "rare", F.explode(mine).alias("x")).select("set", "n", "rare", "x.k", "x.m")
    leaders = marks.groupBy("k", "m").agg(F.min(F.struct("rare", "set", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1").select("k", "m", "lead")
    led = marks.join(leaders, ["k", "m"]).where(f"set <> lead.set and least(n, lead.n) * 100 >= {similar} * greatest(n, lead.n)")
    return led.select(F.col("lead.set").alias("a"), F.col("set").alias("b")).distinct()


def _classes(df: DataFrame, key: str, text: str, words: int, similar: int) -> DataFrame:
    """key, at (hash of the text), n (size of the set) and least (the smallest (key, at) of the component; null for empty sets) of each row."""
    prepare(df.sparkSession)
    frequent = _frequent(df, text, words)
    rows = cut(_summaries(df, key, text, words, frequent))
    sets = cut(rows.where("n > 0").drop("key").dropDuplicates(["set"]))
    links = cut(_probed(df, text, words, similar, cut(_possible(_led(sets, similar), sets, similar)), sets))
    known = components(links)
    orders = _orders(df, text, words, similar, frequent).join(known.withColumnRenamed("node", "set"), "set", "left")
    postings = orders.select("set", "n", "late", "lists", F.coalesce("root", "set").alias("root")).mapInArrow(_postings(similar), ", ".join(f"{c} bigint" for c in POSTING))
    told = postings.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(_told(similar), "query bigint, n bigint, partners array<bigint>, times array<bigint>")
    occurring = told.repartition("query").sortWithinPartitions("query").mapInArrow(_occurring(similar), "a bigint, b bigint")
    more = cut(_probed(df, text, words, similar, cut(_possible(occurring, sets, similar)), sets))
    roots = components(links.union(more)).withColumnRenamed("node", "set")
    # a set or component may hold a third of all rows: its label goes to SALTS tasks
    salt, salts = F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    linked = roots.union(roots.select(F.col("root").alias("set"), "root").distinct())
    first = rows.where("n > 0").groupBy("set").agg(F.min(F.struct("key", "at")).alias("least"))
    least = first.join(linked, "set").groupBy("root").agg(F.min("least").alias("least"))
    labels = linked.select("set", "root", F.pmod(F.xxhash64("set"), F.lit(SALTS)).alias("salt")).join(least.select("root", "least", salts), ["root", "salt"]).select("set", "least")
    labels = first.join(labels.withColumnRenamed("least", "all"), "set", "left").select("set", F.coalesce("all", "least").alias("least"))
    return rows.select("key", "at", "n", "set", salt).join(labels.select("set", "least", salts), ["set", "salt"], "left").select("key", "at", "n", "least")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links, itself included) of each row.

    Rows link when 100 * overlap >= similar * union of their sets of shingles (lower-case ASCII, words between white space). Null and
    wordless texts have no shingle and link with nothing. Equal sets are one class; repeated rows and keys stay as they are; a null key is
    smaller than all others. An empty table gives no rows. Other columns are left out, so their names don't matter. Sets are compared by
    64-bit hashes.
    """
    out = _classes(df, key, text, words, similar)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.key")).otherwise(F.col("key")).alias("component_id"))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similar: int = 80) -> DataFrame:
    """All columns of df; of each component of near duplicates the row with the smallest key (of those, of the smallest hash of the text).

    Rows of the same key and text count as one, and one of them stays (which, is not defined where they differ in other columns). Rows of the
    same key and different texts are judged each by its text. Null and wordless texts stay, once for each key. Null keys are a key like others.
    """
    found = cut(_classes(df, key, text, words, similar))
    first = found.where("n = 0 or (key <=> least.key and at = least.at)").groupBy("key", "at").agg(F.count("*").alias("rows"))
    first = cut(first.select(F.col("key").alias("k"), F.col("at").alias("h"), "rows"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("at"))
    kept = row.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("at") == F.col("h")))
    one = kept.where("rows = 1").select("row")
    if first.where("rows > 1").head(1):
        one = one.union(kept.where("rows > 1").dropDuplicates(["k", "h"]).select("row"))
    return one.select("row.*")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more, as components."""
    return near_duplicates(table(spark, sf_dir, "documents"))
