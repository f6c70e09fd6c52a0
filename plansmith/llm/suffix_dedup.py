"""Repeated byte strings across a corpus, with prefix-free parsing inside each shard.

A byte goes if a string of ``length`` bytes over it starts anywhere else too. Whole texts are dealt to shards by a hash of the text.

1. Contexts. Every window of ``length`` bytes has one anchor: the smallest rolling hash among its first third. The string from the anchor that
   is two thirds long lies within the window, so a window repeats only if its anchor's string does. Each shard sends the hashes of its
   different anchor strings, packed by range of hashes (bucket); buckets answer with one bit for each: whether it occurs twice.
2. Corpus order. The windows that are left, a small and highly repetitive part of the text, go through prefix-free parsing: rolling-hash
   triggers cut phrases that overlap by a trigger; the suffix array of the dictionary of different phrases and the suffix array of the parse
   combine into the order of a block's windows. Equal windows are neighbours there: of equal rank, or of equal bytes where what follows
   the window makes the ranks differ. Each shard sends a 112-bit name for every different window, and buckets answer as before.
3. Each shard marks its repeated windows, joins their spans and cuts them out.

Names only bring windows of different blocks together. Shards and buckets are of bounded size, so both grow with the corpus, and a shard has a
message for each bucket: with more memory for a worker, raise SHARD and BUCKET and there are fewer messages, by the square.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import carried, prepare, release, table
from plansmith.llm.pretokens import mixed

LENGTH = 200
#: Bytes of text in a shard (longer texts alone make it larger), bytes of text whose names meet in a bucket, bytes handled at once.
SHARD, BUCKET, BLOCK = 8 << 20, 16 << 20, 1 << 20
#: Bytes of a trigger; every so many-th hash is one.
TRIGGER, EVERY = 16, 64


def rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of all TRIGGER-byte strings."""
    h = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        for s in (1, 2, 4, 8):
            h = h[:-s] * np.uint32(0x01000193 + 2 * s) + h[s:] if len(h) > s else h[:0]
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)


class Windows:
    """Hashes of strings of any place and one size in a block of bytes; two families of 64 bits."""

    _BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    _powers: dict = {}

    def __init__(self, data: np.ndarray, family: int = 0):
        n = len(data) + 1
        power, self.inverse = self._of(n, family)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1 + family)) * power[: n - 1], out=self.total[1:])

    @classmethod
    def _of(cls, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a base and of its inverse; those for longer texts than blocks aren't kept."""
        kept = cls._powers.get(family)
        if kept is None or len(kept[0]) < n:
            out, base = [], cls._BASES[family]
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, BLOCK + 1), b, np.uint64)
                p[0] = 1
                with np.errstate(over="ignore"):
                    out.append(np.multiply.accumulate(p))
            kept = out[0], out[1]
            if n <= BLOCK + 1:
                cls._powers[family] = kept
        return kept

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[at + size] - self.total[at]) * self.inverse[at] + np.uint64(size))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all windows that lie in one text, the anchor of each)."""
    zone = length // 3
    h = rolling(data)
    count = len(data) - length + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    v = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    x = np.full(-(-len(v) // zone) * zone, np.uint64(2**64 - 1))
    x[: len(v)] = v
    x = x.reshape(-1, zone)
    front, back = np.minimum.accumulate(x, 1).ravel(), np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:count], front[zone - 1 : zone - 1 + count]) & np.uint64(0xFFFFFFFF)
    starts = np.append(0, ends[:-1])
    sizes = np.maximum(ends - starts - length + 1, 0)
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return at, least[at].astype(np.int64)


def blocks(texts: list[bytes]):
    """(first text, data, ends) of runs of texts of about BLOCK bytes."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield a, np.frombuffer(b"".join(texts[a:b]), np.uint8), np.cumsum([len(x) for x in texts[a:b]])
            a, size = b, 0
        size += len(t)
    if texts:
        yield a, np.frombuffer(b"".join(texts[a:]), np.uint8), np.cumsum([len(x) for x in texts[a:]])


def anchor_keys(data: np.ndarray, ends: np.ndarray, length: int):
    """(windows, number of each one's anchor among the anchors, hashes of the anchors' strings)."""
    at, anchor = anchors(data, ends, length)
    w = Windows(data)
    new = np.append(True, anchor[1:] != anchor[:-1]) if len(at) else np.empty(0, bool)
    return at, np.cumsum(new) - 1, w.hashes(anchor[new], length - length // 3 + 1)


def ranks(symbols: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Prefix doubling: the rank of every suffix that ends at its stop, compared up to depth symbols; equal ones have equal ranks.

    symbols: whole numbers, those at stops are lower than all others.
    """
    rank, h = symbols.astype(np.int64), 1
    while h < depth:
        after = rank[np.minimum(np.arange(len(rank)) + h, stop)]
        _, rank = np.unique(rank << 32 | after, return_inverse=True)
        h *= 2
    return rank


def corpus_order(data: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in the order of their bytes, by prefix-free parsing of texts that end at ends; and which have another rank than the one
    before."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[0] = True
    start[ends] = True
    h = rolling(data)
    start[: len(h)] |= h % np.uint32(EVERY) == 0
    begin = np.flatnonzero(start[:n])
    text = np.searchsorted(ends, begin, "right")
    last = np.append(begin[1:], n)
    stop = np.minimum(last + TRIGGER, ends[text])  # phrases overlap by a trigger, but for a text's last
    name = Windows(data)
    size = stop - begin
    with np.errstate(over="ignore"):
        key = mixed((name.total[stop] - name.total[begin]) * name.inverse[begin] + size.astype(np.uint64)) ^ (stop == ends[text]).astype(np.uint64)
    _, one, phrase = np.unique(key, return_index=True, return_inverse=True)
    # the dictionary: the different phrases, each with a stop behind it
    d_size = size[one] + 1
    d_begin = np.cumsum(d_size) - d_size
    within = np.arange(d_size.sum()) - np.repeat(d_begin, d_size)
    source = np.repeat(begin[one], d_size) + within
    at_stop = within == np.repeat(d_size - 1, d_size)
    symbols = np.where(at_stop, 0, data[np.minimum(source, n - 1)].astype(np.int64) + 1)
    order = ranks(symbols, np.repeat(d_begin + d_size - 1, d_size), length)
    # the parse: phrases by their rank, a stop where a text ends
    p_ends = np.searchsorted(begin, ends)
    p_text = np.searchsorted(p_ends, np.arange(len(begin)), "right")
    shift = np.arange(len(begin)) + p_text
    parse = np.zeros(len(begin) + len(ends), np.int64)
    parse[shift] = order[d_begin[phrase]] + 1
    p_stop = p_ends + np.arange(len(ends))
    parse_rank = ranks(parse, np.repeat(p_stop, np.diff(np.append(0, p_ends)) + 1), length)
    mine = np.searchsorted(begin, windows, "right") - 1
    head, tail = order[d_begin[phrase[mine]] + windows - begin[mine]], parse_rank[shift[mine] + 1]
    out = np.lexsort((tail, head))
    head, tail = head[out], tail[out]
    return out, np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])) if len(out) else np.empty(0, bool)


def different(data: np.ndarray, ends: np.ndarray, windows: np.ndarray, names: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-part names of the different windows, and which of them occur twice here."""
    order, new = corpus_order(data, ends, windows, length)
    hi, lo = names[0][order], names[1][order]
    doubt = np.flatnonzero(new[1:] & (hi[1:] == hi[:-1])) + 1  # windows of other ranks may be equal up to their end
    new[doubt] = ~_equal(data, windows[order[doubt - 1]], windows[order[doubt]], length)
    first = np.flatnonzero(new)
    return hi[first], lo[first], np.diff(np.append(first, len(order))) > 1


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes at a and b are the same, eight at a time."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = eight[a[left] + k] == eight[b[left] + k]
    return same


def _unique(hi: np.ndarray, lo: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of two-part names (second parts may be missing), and where new ones begin in it."""
    order = np.argsort(hi, kind="stable")
    h = hi[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    if lo is not None and len(h):
        low = lo[order]
        if (~new[1:] & (low[1:] != low[:-1])).any():
            order = np.lexsort((lo, hi))
            h, low = hi[order], lo[order]
        new = np.append(True, (h[1:] != h[:-1]) | (low[1:] != low[:-1]))
    return order, new


def _six(h: np.ndarray) -> bytes:
    """Whole numbers under 2**48."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(raw: bytes, at: int = 0) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8, offset=at).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _coded(h: np.ndarray) -> bytes:
    """Sorted whole numbers by their differences, six bytes each where they fit."""
    step = np.diff(h, prepend=np.uint64(0))
    big = bool(len(h) > 1 and step[1:].max() >= 1 << 48)
    return bytes([big]) + h[:1].tobytes() + (step[1:].tobytes() if big else _six(step[1:]))


def _decoded(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.empty(0, np.uint64)
    step = np.frombuffer(raw, np.uint64, offset=9) if raw[0] else _of_six(raw, 9)
    with np.errstate(over="ignore"):
        return np.cumsum(np.append(np.frombuffer(raw, np.uint64, 1, 1), step))


def _packed(shard: int, hi: np.ndarray, lo: np.ndarray | None, twice: np.ndarray, buckets: int):
    """Rows (bucket, shard, hi, lo, twice) of different names, sorted; twice: bits."""
    import pyarrow as pa

    bucket = ((hi >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(hi) else np.empty(0, np.int64), len(hi)).tolist()
    cuts = list(zip(edges, edges[1:], strict=False))
    columns = [
        pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()),
        pa.array([shard] * len(cuts), pa.int32()),
        pa.array([_coded(hi[a:b]) for a, b in cuts], pa.binary()),
        pa.array([None if lo is None else _six(lo[a:b]) for a, b in cuts], pa.binary()),
        pa.array([np.packbits(twice[a:b]).tobytes() for a, b in cuts], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, ["bucket", "shard", "hi", "lo", "twice"])


PACKED, ANSWER = "bucket int, shard int, hi binary, lo binary, twice binary", "shard int, kind int, bucket int, n bigint, bits binary"
#: Kinds of answers.
ANCHORS, WINDOWS = 0, 1


def _answers(kind: int):
    """Of a bucket, for every shard: a bit for each of its names, set if it occurs twice in the corpus."""

    def run(key, rows):
        import pyarrow as pa

        release()
        parts = [_decoded(x) for x in rows["hi"].to_pylist()]
        hi = np.concatenate(parts)
        lo = None if rows["lo"].null_count else np.concatenate([_of_six(x) for x in rows["lo"].to_pylist()])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(rows["twice"].to_pylist(), parts, strict=True)])
        order, new = _unique(hi, lo)
        first = np.flatnonzero(new)
        again = (np.diff(np.append(first, len(hi))) > 1) | np.logical_or.reduceat(twice[order], first)
        out = np.empty(len(hi), bool)
        out[order] = again[np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(out[b - len(p) : b]).tobytes() for b, p in zip(ends.tolist(), parts, strict=True)]
        n = pa.array([len(p) for p in parts], pa.int64())
        return pa.Table.from_arrays([rows["shard"].cast(pa.int32()), pa.array([kind] * len(bits), pa.int32()), rows["bucket"].cast(pa.int32()), n, pa.array(bits, pa.binary())], ["shard", "kind", "bucket", "n", "bits"])

    return run


def _answered(rows, kind: int) -> np.ndarray:
    """The bits for a shard's sorted names."""
    told = sorted((b, n, x) for k, b, n, x in zip(*(rows[c].to_pylist() for c in ("kind", "bucket", "n", "bits")), strict=True) if k == kind)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in told]).astype(bool) if told else np.empty(0, bool)


class Shard:
    """What the stages find out about one shard's texts; the same each time, whatever order they come in."""

    def __init__(self, texts: list[bytes], length: int, answers=None):
        self.texts, self.length = texts, length
        if answers is not None:
            h = np.unique(np.concatenate([anchor_keys(data, ends, length)[2] for _, data, ends in blocks(texts)] or [np.empty(0, np.uint64)]))
            self.repeated = h[_answered(answers, ANCHORS)]

    def left(self):
        """(first text, data, ends, windows whose anchor strings repeat, their names) of each block."""
        for k, data, ends in blocks(self.texts):
            at, number, keys = anchor_keys(data, ends, self.length)
            left = at[_member(keys, self.repeated)[number]] if len(at) else at
            hi, lo = (Windows(data, f).hashes(left, self.length) if len(left) else np.empty(0, np.uint64) for f in (0, 1))
            yield k, data, ends, left, (hi, lo >> np.uint64(16))

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the shard's different windows, sorted, and which occur twice in it; by the order of blocks, then between blocks."""
        done: list = []
        keep: list = []
        names: list = []

        def order():
            ends = np.cumsum([len(x) for x in keep])
            runs = np.diff(np.append(0, ends)) - self.length + 1
            at = np.repeat(ends - np.cumsum(runs) - self.length + 1, runs) + np.arange(runs.sum())
            done.append(different(np.concatenate(keep), ends, at, tuple(np.concatenate(x) for x in zip(*names, strict=True)), self.length))
            keep.clear()
            names.clear()

        for _, data, _, left, own in self.left():
            if not len(left):
                continue
            cut = np.append(0, np.flatnonzero(np.diff(left) > 1) + 1)  # runs of windows
            keep += [data[x : y + self.length] for x, y in zip(left[cut].tolist(), left[np.append(cut[1:], len(left)) - 1].tolist(), strict=True)]
            names.append(own)
            if sum(map(len, keep)) > BLOCK:
                order()
        if keep:
            order()
        if not done:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
        hi, lo, twice = (np.concatenate(x) for x in zip(*done, strict=True))
        order_, new = _unique(hi, lo)
        first = np.flatnonzero(new)
        return hi[order_[first]], lo[order_[first]], (np.diff(np.append(first, len(hi))) > 1) | np.logical_or.reduceat(twice[order_], first)

    def gone(self, answers):
        """(first text, data, ends, bytes that go) of each block."""
        parts = list(self.left())
        every = [np.concatenate(x) for x in zip(*(names for *_, names in parts), strict=True)] if parts else [np.empty(0, np.uint64)] * 2
        order, new = _unique(*every)
        again = np.empty(len(order), bool)
        again[order] = _answered(answers, WINDOWS)[np.cumsum(new) - 1] if len(order) else False
        at = 0
        for k, data, ends, left, _ in parts:
            hit = left[again[at : at + len(left)]]
            at += len(left)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + self.length, -1)
            yield k, data, ends, np.cumsum(step[:-1]) > 0


def _member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """of: sorted."""
    if not len(of):
        return np.zeros(len(h), bool)
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def _texts_of(rows) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """Different texts of a shard by their hashes, and how many copies the corpus has; rows without a text only count copies."""
    texts: dict = {}
    for a, b, t, n in zip(*(rows[c].to_pylist() for c in ("h1", "h2", "text", "n")), strict=True):
        had = texts.setdefault((a, b), [None, 0])
        had[0] = t.encode("utf-8", "surrogatepass") if had[0] is None and t is not None else had[0]
        had[1] += n
    return list(texts), [t for t, _ in texts.values()], [n for _, n in texts.values()]


def shards(df: DataFrame, text: str, count: int) -> DataFrame:
    """(shard, h1, h2, text, n): texts dealt by their hash; a partition sends a text once, and then the number of its further copies."""
    frame = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("text", *_names())
    frame = frame.select(F.pmod("h1", F.lit(count)).cast("int").alias("shard"), "h1", "h2", "text")

    def run(batches):
        import pyarrow as pa

        more: dict = {}
        for batch in batches:
            keep = []
            for i, k in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if k in more:
                    more[k] += 1
                else:
                    more[k] = 0
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([1] * len(keep), pa.int64())], ["shard", "h1", "h2", "text", "n"])
        again = [(*k, n) for k, n in more.items() if n]
        if again:
            s, a, b, n = zip(*again, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(s), pa.string()), pa.array(n, pa.int64())], ["shard", "h1", "h2", "text", "n"])

    return frame.mapInArrow(run, "shard int, h1 bigint, h2 bigint, text string, n bigint").repartition(count, "shard")


def _names(text: str = "text"):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), F.col(text)).alias("h2")


def repeated(df: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """h1, h2 (hashes of a text), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (valid characters of the bytes left) of each
    different text. Null counts as empty; texts under ``length`` bytes lose nothing. ``length``: 48 at least."""
    spark = df.sparkSession
    prepare(spark)
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).head()[0] or 0
    count, buckets = max(1, -(-size // SHARD)), max(1, -(-size // BUCKET))
    texts = shards(df, text, count)

    def contexts(batches):
        seen, keys = set(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pydict()
            group: dict = {}
            for s, a, b, t in zip(rows["shard"], rows["h1"], rows["h2"], rows["text"], strict=True):
                if t is not None and (a, b) not in seen:
                    seen.add((a, b))
                    group.setdefault(s, []).append(t.encode("utf-8", "surrogatepass"))
            for s, part in group.items():
                for _, data, ends in blocks(part):
                    keys.setdefault(s, []).append(anchor_keys(data, ends, length)[2])
        for s, parts in keys.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield from _packed(s, h, None, n > 1, buckets).to_batches()
        release()

    first = texts.mapInArrow(contexts, PACKED).groupBy("bucket").applyInArrow(_answers(ANCHORS), ANSWER)

    def windows(key, rows, answers):
        release()
        _, found, _ = _texts_of(rows)
        return _packed(key[0].as_py(), *Shard(found, length, answers).names(), buckets)

    second = texts.groupBy("shard").cogroup(first.groupBy("shard")).applyInArrow(windows, PACKED)
    third = second.groupBy("bucket").applyInArrow(_answers(WINDOWS), ANSWER)

    def marked(key, rows, answers):
        import pyarrow as pa

        release()
        names, found, copies = _texts_of(rows)
        out: list = []
        for k, data, ends, gone in Shard(found, length, answers).gone(answers):
            a = 0
            for i, b in enumerate(ends.tolist()):
                own = gone[a:b] if copies[k + i] < 2 or b - a < length else np.ones(b - a, bool)
                edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                left_over = data[a:b][~own].tobytes() if own.any() else data[a:b].tobytes()
                out.append((*names[k + i], b - a, int(own.sum()), int((edge == 1).sum()), hashlib.sha256(left_over).hexdigest(), left_over.decode("utf-8", "ignore") if with_text else None))
                a = b
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)][: 6 + with_text], columns[: 6 + with_text])

    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    columns = ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "h1 bigint, h2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text
    return texts.groupBy("shard").cogroup(first.union(third).groupBy("shard")).applyInArrow(marked, schema)


def remove_repeated(df: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, n_removed, n_spans, kept_sha256 (and kept), which replace columns of the same names.

    Repeated rows stay repeated; copies of a text of ``length`` bytes or more lose all of it. Null counts as empty. Columns that aren't kept
    don't matter; an empty table gives no rows.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    row, back = carried(df, keep, added)
    named = df.select(row, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("row", *_names())
    return back(named.join(repeated(df, text, length, with_text), ["h1", "h2"]))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without 200-byte strings that occur twice."""
    return remove_repeated(table(spark, sf_dir, "documents"), ["doc_id"])
