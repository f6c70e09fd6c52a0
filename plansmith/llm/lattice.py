"""Subword lattices: all ways to write words with the pieces of an existing vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plansmith.llm.pretokens import Table, span_hashes

#: Words longer than this many bytes are scored one by one; their expected counts go by batches of so many cells (words x longest), or alone.
LONG, CELLS = 192, 1 << 18
#: Pieces' worth of the prior beside expected counts.
PRIOR = 100


@dataclass
class Vocabulary:
    """Pieces as bytes (a word's blank stands before it) with their existing scores as a place in the order of frequency; one end piece."""

    pieces: list[bytes]
    order: np.ndarray  #: from 0, most frequent first

    @classmethod
    def read(cls, file: str) -> Vocabulary:
        """A sentencepiece model: normal pieces, and byte pieces for what they don't cover. Scores fall as pieces get rarer."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces, scores = [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                pieces.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                piece = model.id_to_piece(i).replace("▁", " ")
                if " " in piece[1:] or piece != piece.translate(LOWER):
                    continue  # between words, or with capitals, which scored texts don't have
                pieces.append(piece.encode())
            scores.append(model.get_score(i))
        missing = [b for b in (bytes([k]) for k in range(256)) if b not in set(pieces)]
        pieces += missing
        scores += [min(scores, default=0) - 1] * len(missing)
        best: dict = {}
        for p, s in zip(pieces, scores, strict=True):
            best[p] = max(best.get(p, -np.inf), s)
        names = sorted(best, key=lambda p: (-best[p], p))
        return cls(names, np.arange(len(names)))

    def prior(self) -> np.ndarray:
        """The unigram model that the existing scores stand for, the end piece last: scores of merges give the order of frequency alone, so
        probabilities are those of Zipf's law for it."""
        w = 1 / (self.order + 2.7)
        w = np.append(w, w.sum() / 400)
        return w / w.sum()

    def weights(self) -> np.ndarray:
        """Natural logarithms of the prior."""
        return np.log(self.prior())

    def with_counts(self, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weights, a row for each class: expected counts of pieces (classes x pieces) and numbers of ends, and the prior as PRIOR more pieces."""
        n = np.concatenate([counts, np.asarray(ends, float)[:, None]], 1) + PRIOR * self.prior()
        return np.log(n / n.sum(1, keepdims=True))


LOWER = {c: c + 32 for c in range(65, 91)}


class Lattice:
    """Forward and backward sums over the segmentations of words; weights: natural logarithms, the end piece last, a row for each class."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.weights = np.atleast_2d(weights)[:, :-1]
        sizes = np.array([len(p) for p in vocabulary.pieces])
        self.most = int(sizes.max())
        self.table = Table(18)
        data = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        ends = np.cumsum(sizes)
        self.table.add(span_hashes(data, ends - sizes, ends), np.arange(len(sizes)))
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces)}

    def arcs(self, words: list[bytes]):
        """(word, start, end, piece) of every arc, by end, then word; and the words' lengths with their blank."""
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        sizes = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(data)) - begin[owner]
        room = sizes[owner] - place
        found = []
        for n in range(1, self.most + 1):
            at = np.flatnonzero(room >= n)
            if not len(at):
                break
            piece = self.table.find(span_hashes(data, at, at + n))
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
        at, n, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        word, start = owner[at], place[at]
        order = np.lexsort((word, start + n))
        return word[order], start[order], (start + n)[order], piece[order], sizes

    def forward(self, words, k: int, arcs) -> tuple[np.ndarray, np.ndarray]:
        """log sums over all segmentations up to each place of each word (a matrix), and of whole words, in class k."""
        word, start, end, piece, sizes = arcs
        alpha = np.full((len(words), int(sizes.max()) + 1), -np.inf)
        alpha[:, 0] = 0
        score = self.weights[k][piece]
        edges = np.searchsorted(end, np.arange(1, alpha.shape[1] + 1))
        for e in range(1, alpha.shape[1]):
            a, b = edges[e - 1], edges[e]
            _sum(alpha[:, e], word[a:b], alpha[word[a:b], start[a:b]] + score[a:b])
        return alpha, alpha[np.arange(len(words)), sizes]

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur so many times (words x classes): classes x pieces."""
        word, start, end, piece, sizes = self.arcs(words)
        out = np.zeros(self.weights.shape)
        for c in np.flatnonzero(times.any(0)):
            mine = times[:, c] > 0  # a class's own words only
            new, hit = np.cumsum(mine) - 1, mine[word]
            own = new[word[hit]], start[hit], end[hit], piece[hit], sizes[mine]
            out[c] = self._expected(c, own, times[mine, c])
        return out

    def _expected(self, c: int, arcs, times: np.ndarray) -> np.ndarray:
        word, start, end, piece, sizes = arcs
        alpha, whole = self.forward(sizes, c, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(sizes)), sizes] = 0
        score = self.weights[c][piece]
        back = np.lexsort((word, start))
        edges = np.searchsorted(start[back], np.arange(alpha.shape[1] + 1))
        for s in reversed(range(alpha.shape[1] - 1)):
            k = back[edges[s] : edges[s + 1]]
            _sum(beta[:, s], word[k], beta[word[k], end[k]] + score[k])
        share = np.exp(alpha[word, start] + score + beta[word, end] - whole[word])
        return np.bincount(piece, share * times[word], len(self.weights[c]))

    def long_word(self, word: bytes) -> np.ndarray:
        """One word of any length."""
        text, ids = b" " + word, self.ids
        alpha = np.full((len(text) + 1, len(self.weights)), -np.inf)
        alpha[0] = 0
        for e in range(1, len(text) + 1):
            x = np.array([alpha[s] + self.weights[:, i] for s in range(max(0, e - self.most), e) if (i := ids.get(text[s:e])) is not None])
            top = x.max(0)
            alpha[e] = top + np.log(np.exp(x - top).sum(0))
        return alpha[-1]

    def scores(self, words: list[bytes], batch: int = 20_000) -> np.ndarray:
        """Natural log probability of each word with its blank, over all segmentations: words x classes."""
        out = np.zeros((len(words), len(self.weights)))
        for at in batches(words, batch):
            part = [words[k] for k in at]
            arcs = self.arcs(part)
            for c in range(len(self.weights)):
                out[at, c] = self.forward(part, c, arcs)[1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.long_word(w)
        return out


def batches(words: list[bytes], size: int = 20_000):
    """Numbers of the words that aren't long, words of like lengths together."""
    short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], np.int64)
    if len(short):
        short = short[np.argsort([len(words[k]) for k in short], kind="stable")]
    for a in range(0, len(short), size):
        yield short[a : a + size]


def long_batches(words: list[bytes]):
    """Numbers of the long words, words of like lengths together; one that has more cells than a batch may have goes alone."""
    own: list[int] = []
    for k in sorted((k for k, w in enumerate(words) if len(w) > LONG), key=lambda k: len(words[k])):
        if own and (len(own) + 1) * (len(words[k]) + 2) > CELLS:
            yield np.array(own)
            own = []
        own.append(k)
    if own:
        yield np.array(own)


def _sum(out: np.ndarray, word: np.ndarray, x: np.ndarray) -> None:
    """out[word] = log of the sum of exp(x) over each word's entries, which stand together."""
    if len(x):
        new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        top = np.maximum.reduceat(x, new)
        safe = np.where(np.isfinite(top), top, 0)
        out[word[new]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(new, len(x))))), new))
