"""Token counts: byte-level BPE by rank-synchronous array merging.

Pre-tokens of a batch that are new to the worker lie in one flat array of symbols with their sequence's number. Each round looks up the
rank of every neighbouring pair, takes each sequence's lowest rank and merges all its occurrences at once; sequences without a known pair
leave. In a vocabulary where each merge makes a symbol of its own, no merge makes a pair of a lower rank, so this gives what merging one
occurrence at a time gives.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import carried, in_pieces, prepare, table
from plansmith.llm.pretokens import Split, Table, chunks, mixed, odd_texts

#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Symbols that are merged at once, and bytes of text handled at once.
SYMBOLS, BYTES = 1 << 19, 2 << 20
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Merger:
    """Counts the symbols that remain of byte sequences."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE without a normaliser is needed")
        vocabulary = model["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        if len(np.unique(self.made)) != len(pairs):
            raise ValueError("two merges make the same symbol")
        self.ranks = Table(18)
        self.ranks.add(self._keys(left, right), np.arange(len(pairs)))

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mixed(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def _rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = self.ranks.find(self._keys(symbols[at], symbols[at + 1]))
        return np.where(found < 0, NONE, found)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        counts = np.zeros(len(sequences), np.int64)
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        part = (np.cumsum(sizes) - sizes) // SYMBOLS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sequences)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                counts[a:b] = self._merge(b"".join(sequences[a:b]), sizes[a:b])
        return counts

    def _merge(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        left = np.zeros(len(sizes), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = self.of_byte[np.frombuffer(data, np.uint8)]
        n = len(symbols)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(symbols, inner)
        while n := len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(begin, n))
            least = np.minimum.reduceat(rank, begin)
            over = least == NONE
            if over.any():
                left[owner[begin[over]]] = length[over]
                stay = ~np.repeat(over, length)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                least, length = least[~over], length[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            head = np.append(True, np.diff(hit) > 1)  # of three equal symbols in a row the first two merge
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            fresh = place[hit]
            fresh = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            rank[fresh] = NONE
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self._rank(symbols, fresh)
        return left


class Counter:
    """Tokens of whole texts; a worker remembers the counts of pre-tokens."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.merger, self.library = Merger(file), Tokenizer.from_file(file)
        self.forget()

    def forget(self) -> None:
        self.table, self.n, self.counts = Table(), 0, np.empty(1 << 14, np.int32)

    def count(self, texts: list[str]) -> np.ndarray:
        """The library's default: a special token's string inside a text is that token."""
        total = np.zeros(len(texts), np.int64)
        odd = odd_texts(texts)
        for k in odd:  # unassigned code points: pre-tokens as the library finds them
            total[k] = len(self.library.encode(texts[k], add_special_tokens=False).ids)
        rest = [("" if k in odd else t) for k, t in enumerate(texts)]
        owner = list(range(len(rest)))
        for special in self.merger.special:
            if any(special in t for t in rest):
                parts = [(k, p, j) for k, t in zip(owner, rest, strict=True) for j, p in enumerate(t.split(special))]
                for k, _, j in parts:
                    total[k] += j > 0
                owner, rest = [k for k, _, _ in parts], [p for _, p, _ in parts]
        for numbers, pieces in chunks(rest):
            if self.n > REMEMBERED:
                self.forget()
            split = Split(pieces)
            rows = self.table.find(split.hash)
            unknown = np.flatnonzero(rows < 0)
            if len(unknown):
                h, at = np.unique(split.hash[unknown], return_index=True)
                found = self.merger.count([s.encode() for s in split.strings(unknown[at])])
                if self.n + len(h) > len(self.counts):
                    self.counts = np.resize(self.counts, 2 * (self.n + len(h)))
                self.counts[self.n : self.n + len(h)] = found
                self.table.add(h, np.arange(self.n, self.n + len(h)))
                self.n += len(h)
                rows[unknown] = self.table.find(split.hash[unknown])
            mine = np.bincount(split.piece, self.counts[rows], len(pieces)).astype(np.int64)
            np.add.at(total, [owner[k] for k in numbers], mine)
        return total


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """Adds to the columns ``keep`` the number of tokens of each row's whole text; a null text counts as empty, an empty one has 0 tokens.

    Rows stay as they are (repeated rows too, an empty table gives none), nothing is shuffled. Other columns don't reach Python, so their names
    don't matter; a kept column named ``out`` is replaced.
    """
    prepare(df.sparkSession)
    row, back = carried(df, keep, [out])
    frame = df.select(row, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        if file not in _counters:
            _counters[file] = Counter(file)
        for piece in in_pieces(batches, 1, BYTES):
            n = _counters[file].count(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64())], ["row", out])

    return back(frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, `{out}` bigint"))


#: Tokens that a document may have before op6 marks it.
LIMIT = 512


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document (null text: empty)."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
