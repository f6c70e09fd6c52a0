"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a run of documents as word numbers of the benchmark's vocabulary. Words that no benchmark item has can't be in an occurrence:
they end a run, and runs shorter than the shortest window go, so the index holds what could match and nothing else. All windows of the
benchmark are searched backward at once through the ranks of a wavelet matrix over the Burrows-Wheeler transform; the rows found walk back
to sampled suffix positions; the words of all occurrences merge into spans.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import carried, gathered, in_pieces, prepare, shared_dir, table

#: Words of a window; bytes of text in a shard; every so many-th position of a suffix array is kept.
WINDOW, BYTES, SAMPLE = 10, 4 << 20, 8
#: Benchmark words in a block. One block is broadcast; if there are more, each lies in a file in the shared folder and shards go through them in turn.
BLOCK_WORDS = 1 << 18
#: Bytes of text that meet each of several benchmark blocks at once.
MANY = 16 << 20
#: A-Z to a-z; ASCII other than letters and digits to blanks.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass
class Block:
    """Windows of some benchmark items."""

    vocabulary: dict  #: word -> number from 1
    windows: np.ndarray  #: different windows x WINDOW, ended by zeros
    sizes: np.ndarray
    first: np.ndarray  #: items of window i: items[first[i]:first[i + 1]]
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, list[bytes]]], window: int) -> Block:
        vocabulary: dict = {}
        found: dict = {}
        for item, words in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), {})[item] = None
        windows = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            windows[i, : len(w)] = w
        names = list(found.values())
        return cls(vocabulary, windows, (windows > 0).sum(1), np.cumsum([0, *map(len, names)]), [x for n in names for x in n])


class WaveletMatrix:
    """Ranks of symbols in an array."""

    def __init__(self, symbols: np.ndarray, highest: int):
        self.levels, self.zeros, self.ones = max(1, int(highest).bit_length()), [], []
        for k in reversed(range(self.levels)):
            bit = (symbols >> k) & 1
            self.ones.append(np.append(0, np.cumsum(bit, dtype=np.int32)).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        begin = np.zeros_like(end)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            a, b = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + a, begin - a), np.where(bit, zeros + b, end - b)
        return end - begin

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and their ranks there."""
        symbol, begin, end = np.zeros_like(place), np.zeros_like(place), place
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[end + 1] - ones[end] == 1
            symbol = symbol << 1 | bit
            a, b = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + a, begin - a), np.where(bit, zeros + b, end - b)
        return symbol, end - begin


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Prefix doubling; text: whole numbers below 2 ** 31, suffixes differ within depth."""
    rank, h = text.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1 if h < len(rank) else 0
        key = rank << 32 | after
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank[order] = new
        h *= 2
        if new[-1] == len(rank) - 1 or h > 2 * depth:
            return order


class FMIndex:
    """Over runs of numbers from 1; run_starts: where each begins. Each run is followed by a stop of its own."""

    def __init__(self, runs: np.ndarray, run_starts: np.ndarray):
        sizes = np.diff(np.append(run_starts, len(runs)))
        stops = len(sizes)
        self.shift = np.arange(stops) + run_starts  # places with the stops counted
        n = len(runs) + stops
        text = np.empty(n, np.int64)
        mask = np.ones(n, bool)
        mask[self.shift + sizes] = False
        text[mask], text[~mask] = runs + stops - 1, np.arange(stops)  # stops are the lowest symbols, each its own
        order = suffix_array(text, int(sizes.max()) + 1)
        plain = np.zeros(n, np.int64)
        plain[mask] = runs
        highest = int(runs.max())
        last = plain[order - 1]
        self.count = np.append(0, np.cumsum(np.bincount(plain, minlength=highest + 1)))
        self.wavelet, self.highest = WaveletMatrix(last, highest), highest
        keep = np.zeros(n, bool)
        place = np.arange(n) - self.shift[np.searchsorted(self.shift, np.arange(n), "right") - 1]
        keep[place % SAMPLE == 0] = True  # every run's first word too
        self.sampled = keep[order]
        self.samples, self.sample_rank = order[self.sampled], np.cumsum(self.sampled) - 1

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix array that begin with each window."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.sampled))
        for k in reversed(range(windows.shape[1])):
            live = np.flatnonzero((k < sizes) & (low < high))
            symbol = windows[live, k]
            none = symbol > self.highest
            high[live[none]] = low[live[none]]
            live, symbol = live[~none], symbol[~none]
            low[live], high[live] = self.count[symbol] + self.wavelet.rank(symbol, low[live]), self.count[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the runs of rows of the suffix array."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, rank = self.wavelet.at(rows)
            rows, steps = self.count[symbol] + rank, steps + 1
        return out - (np.searchsorted(self.shift, out, "right") - 1)


def occurrences(docs: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words of the shard, window) of every occurrence of a block's windows within one document."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(block.windows):
        return none
    get = block.vocabulary.get
    ids = np.fromiter((i for d in docs for i in (*(get(w, 0) for w in d), 0)), np.int64, sum(map(len, docs)) + len(docs))
    known = np.concatenate([[False], ids > 0])
    begin = np.flatnonzero(known[1:] & ~known[:-1])
    end = np.flatnonzero(known[:-1] & ~known[1:])
    long = end - begin >= block.sizes.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return none
    size = end - begin
    starts = np.cumsum(size) - size
    source = np.arange(size.sum()) + np.repeat(begin - starts, size)
    index = FMIndex(ids[source], starts)
    low, high = index.search(block.windows, block.sizes)
    many = high - low
    window = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(window)) + np.repeat(low - np.cumsum(many) + many, many)
    place = source[index.locate(rows)]
    ends_before = np.cumsum([len(d) + 1 for d in docs])
    return place - np.searchsorted(ends_before, place, "right"), window


def blocks_of(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text"):
    """Blocks of up to BLOCK_WORDS words; the driver holds one at a time. Null texts have no words."""
    rows, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text).cast("string")).toLocalIterator():
        words = words_of(r[1])
        if words:
            rows.append((r[0], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield Block.of(rows, window)
            rows, size = [], 0
    if rows:
        yield Block.of(rows, window)


def decontaminate(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, cleaned: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated and spans (word places
    from, to of the merged spans, sorted). cleaned: a column for the text without the spans.

    Null and empty texts have no words and aren't contaminated; items that repeat count once. Rows stay as they are, nothing is shuffled; an
    empty table gives none. Kept columns that have the name of a new one are replaced.
    """
    from plansmith.llm.token_files import _store

    spark = df.sparkSession
    prepare(spark)
    whole, files = [], []
    folder = f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}"
    for block in blocks_of(benchmark, window):
        if whole:  # more than one: to files
            store, path = _store(folder)
            store.create_dir(path, recursive=True)
            for b in [block] if files else [*whole, block]:
                files.append(f"{path}/{len(files)}")
                with store.open_output_stream(files[-1]) as out:
                    out.write(pickle.dumps(b))
        else:
            whole.append(block)
    shared = spark.sparkContext.broadcast(whole if not files else [])  # one block: BLOCK_WORDS words and one item's at most
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *[cleaned] * bool(cleaned)]
    row, back = carried(df, keep, added)
    frame = df.select(F.col(text).cast("string").alias("text"), row)

    def blocks():
        yield from shared.value
        for f in files:
            with _store(folder)[0].open_input_stream(f) as source:
                yield pickle.loads(source.read())

    def run(batches):
        import pyarrow as pa

        for batch in in_pieces(gathered(batches, 0, MANY) if files else batches, 0, MANY if files else BYTES):
            docs = [words_of(t) for t in batch.column(0).to_pylist()]
            n = np.array([len(d) for d in docs], np.int64)
            begin = np.cumsum(n) - n
            step = np.zeros(int(n.sum()) + 1, np.int64)
            items: list[set] = [set() for _ in docs]
            for block in blocks():
                place, w = occurrences(docs, block)
                np.add.at(step, place, 1)
                np.add.at(step, place + block.sizes[w], -1)
                doc = np.searchsorted(begin + n, place, "right")
                for d, k in np.unique(np.stack([doc, w], 1), axis=0).tolist():
                    items[d].update(block.items[block.first[k] : block.first[k + 1]])
            hit = np.append(0, np.cumsum(np.cumsum(step[:-1]) > 0))
            spans = []
            for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True):
                own = np.diff(hit[a : b + 1]) if hit[b] > hit[a] else np.empty(0, int)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                spans.append([{"from": int(x), "to": int(y)} for x, y in edge.reshape(-1, 2)])
            n_hit = hit[begin + n] - hit[begin]
            digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            new = [pa.array(n), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digest), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
            if cleaned:
                new.append(pa.array([without_spans(t, s) if s else t for t, s in zip(batch.column(0).to_pylist(), spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *new], ["row", *added])

    fields = [f"row {frame.schema['row'].dataType.simpleString()}", "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<from:int,to:int>>"]
    return back(frame.mapInArrow(run, ", ".join([*fields, *[f"`{cleaned}` string"] * bool(cleaned)])))


def without_spans(text: str, spans) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(WORDS), np.uint8) == 32
    start = np.flatnonzero(~flat & np.append(True, flat[:-1]))
    end = np.flatnonzero(~flat & np.append(flat[1:], True)) + 1
    out, at = [], 0
    for s in spans:
        out.append(raw[at : start[s["from"]]])
        at = int(end[s["to"] - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all documents."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("spans")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
f AS (SELECT doc_id, i, o.k AS k, item FROM o JOIN g ON o.s = g.s AND o.k = g.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM f)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
