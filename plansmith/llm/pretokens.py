"""Pre-tokens of byte-level BPE vocabularies found with numpy over arrays of code points, and a vectorised hash table for them.

The splitting rule is the public byte-level BPE pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = 0, 1, 2, 3, 4
#: Code points with the property White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points handled at once; a longer text is cut where a pre-token surely starts.
CHUNK = 1 << 19


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point. What this Python's tables don't assign may be a letter to a library with newer ones."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((UNASSIGNED if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def odd_texts(texts: list[str]) -> set[int]:
    """Numbers of the texts with unassigned code points; their pre-tokens are left to the library."""
    if not texts or not (classes()[code_points("".join(texts))] == UNASSIGNED).any():
        return set()
    return {k for k, t in enumerate(texts) if t and (classes()[code_points(t)] == UNASSIGNED).any()}


def starts_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. first: marks the first code point of each text; points must not be empty."""
    n = len(points)
    kind = classes()[points]
    changed = first.copy()
    changed[1:] |= kind[1:] != kind[:-1]
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    space = kind == SPACE
    start = changed & (space | ~after_blank)
    last_white = np.zeros(n, bool)  # the last white space before a word of the same text
    last_white[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last_white
    marks = np.flatnonzero((points == 0x27) & start)
    if len(marks):
        _contractions(points, first, changed, kind, start, marks)
    return np.flatnonzero(start)


def _contractions(points, first, changed, kind, start, marks) -> None:
    """Moves the starts around 's 't 're 've 'm 'll 'd."""
    n = len(points)
    pad = np.concatenate([points, np.zeros(3, np.uint32)])
    fence = np.concatenate([first, np.ones(3, bool)])
    one, two = pad[marks + 1], pad[marks + 2]
    near = ~fence[marks + 1]
    short = near & np.isin(one, [ord(c) for c in "stmd"])
    long = near & ~short & ~fence[marks + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for hit, size in ((short, 2), (long, 3)):
        at = marks[hit]
        start[at + 1] = False
        after = at + size
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~changed[after]]] = True


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


_kept: list[np.ndarray] = []
#: Values for which powers are kept.
KEPT = 1 << 21


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if _kept and len(_kept[0]) >= n:
        return _kept
    base, out = int(_BASE), []
    with np.errstate(over="ignore"):
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << min(20, n.bit_length())), np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    if n <= KEPT:
        _kept[:] = out
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a public finaliser of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], the same for the same values anywhere."""
    power, inverse = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Table:
    """Maps 64-bit hashes to row numbers with open addressing, whole arrays at a time."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unknown."""
        at, mask = self._slots(h), (1 << self.bits) - 1
        out = self.rows[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            rows = self.rows[at]
            out[todo] = rows
            more = (rows >= 0) & (self.keys[at] != h[todo])
            todo, at = todo[more], at[more]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """h: distinct and unknown."""
        if 2 * (self.used + len(h)) > 1 << self.bits:
            full = self.rows >= 0
            old = self.keys[full], self.rows[full]
            while 2 * (self.used + len(h)) > 1 << self.bits:
                self.bits += 1
            self.clear(self.bits)
            self._put(*old)
        self._put(h, rows)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        self.used += len(h)
        at, mask = self._slots(h), (1 << self.bits) - 1
        while len(h):
            free = np.flatnonzero(self.rows[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.rows[at[put]] = h[put], rows[put]
            rest = np.ones(len(h), bool)
            rest[put] = False
            h, rows, at = h[rest], rows[rest], (at[rest] + 1) & mask


def cut_long(text: str, most: int = CHUNK):
    """Pieces of a text that split into pre-tokens as the whole does: each begins with a blank between two visible characters."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) - 1 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def chunks(texts: list[str]):
    """(numbers of the texts, pieces) of up to about CHUNK code points; a text may go over several chunks."""
    numbers, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in cut_long(text) if len(text) > CHUNK else (text,):
            if not piece:
                continue
            if size + len(piece) > CHUNK and size:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
            numbers.append(k)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield numbers, pieces


class Split:
    """Pre-tokens of pieces of text: where they start and end in the joined text, their piece, and their hashes."""

    def __init__(self, pieces: list[str]):
        self.text = "".join(pieces)
        points = code_points(self.text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[begin] = True
        self.start = starts_of(points, first)
        self.end = np.append(self.start[1:], len(points))
        self.piece = np.searchsorted(begin, self.start, "right") - 1
        self.hash = span_hashes(points, self.start, self.end)

    def strings(self, numbers: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[numbers].tolist(), self.end[numbers].tolist(), strict=True)]
