"""Whole texts to byte-level BPE ids. The tokenizers library encodes each new pre-token once; known ones are looked up in arrays."""

from __future__ import annotations

import os

import numpy as np

from plansmith.llm.pretokens import Split, Table, chunks, odd_texts

#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, for a byte-level BPE without normaliser."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.table, self.n, self.pool = Table(), 0, 0
        self.ids, self.offset, self.size = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, split: Split, unknown: np.ndarray) -> None:
        h, at = np.unique(split.hash[unknown], return_index=True)
        found = [e.ids for e in self.library.encode_batch_fast(split.strings(unknown[at]), add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        self.ids = _room(self.ids, self.pool + len(ids))
        self.offset, self.size = _room(self.offset, self.n + len(h)), _room(self.size, self.n + len(h))
        self.ids[self.pool : self.pool + len(ids)] = ids
        self.offset[self.n : self.n + len(h)] = self.pool + np.cumsum(size) - size
        self.size[self.n : self.n + len(h)] = size
        self.table.add(h, np.arange(self.n, self.n + len(h)))
        self.n, self.pool = self.n + len(h), self.pool + len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        odd = odd_texts(texts)
        whole = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if k in odd or any(s in t for s in self.special)}
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        for numbers, pieces in chunks([("" if k in whole else t) for k, t in enumerate(texts)]):
            if self.n > REMEMBERED:
                self.forget()
            split = Split(pieces)
            rows = self.table.find(split.hash)
            unknown = np.flatnonzero(rows < 0)
            if len(unknown):
                self._learn(split, unknown)
                rows[unknown] = self.table.find(split.hash[unknown])
            size = self.size[rows]
            total = np.cumsum(size)
            parts.append(self.ids[np.repeat(self.offset[rows] - total + size, size) + np.arange(total[-1])])
            numbers = np.asarray(numbers)
            mine = np.bincount(split.piece, size, len(pieces)).astype(np.int64)
            np.add.at(counts, numbers, mine)
            owners.append(numbers)
        if whole:
            return self._merge(texts, whole, counts, np.concatenate(parts) if parts else np.empty(0, np.uint32))
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), counts

    @staticmethod
    def _merge(texts, whole, counts, ids):
        parts, at = [], 0
        for k in range(len(texts)):
            if k in whole:
                parts.append(np.asarray(whole[k], np.uint32))
                counts[k] = len(whole[k])
            else:
                parts.append(ids[at : at + counts[k]])
                at += counts[k]
        return np.concatenate(parts), counts


def _room(array: np.ndarray, least: int) -> np.ndarray:
    if least <= len(array):
        return array
    new = np.empty(max(least, 2 * len(array)), array.dtype)
    new[: len(array)] = array
    return new


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder for each file in a worker process."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
