"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text's features are the byte 2-, 3- and 4-grams of its words (runs of letters, ASCII ones in lower case, with a blank at either end). Each
is hashed into a bucket with an embedding; the text's vector is the mean over all features of the whole text, and a linear softmax over it
gives the probabilities. A temperature and a rejection threshold are calibrated on rows kept out of training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import carried, in_pieces, prepare, table

#: Bound of the training sample: labelled rows of each language (expected number), languages (the most frequent), and bytes of a row's text.
ROWS_PER_LANGUAGE, LANGUAGES, ROW_BYTES = 1500, 256, 32768
#: Buckets of features, length of embeddings, passes over the sample, first learning rate, and every how many rows one goes to calibration.
BUCKETS_LOG2, DIMENSIONS, EPOCHS, RATE, CALIBRATE = 16, 8, 4, 5.0, 5
#: The share of rightly predicted calibration rows whose confidence lies below the threshold: what rejection may cost in rows of known languages.
LOST = 0.005
#: Fewer right rows than 1 / LOST don't show that quantile: this share of their lowest confidence stands for it.
MARGIN = 0.9
UNKNOWN = "und"
BYTES = 1 << 20
#: ASCII letters to lower case, other ASCII to blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of the features of bytes that LETTERS has translated."""
    b = np.frombuffer(data, np.uint8)
    blank = b == 32
    h, places, buckets = b.astype(np.uint32), [], []
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
            good = ~(blank[: len(b) - n + 1] & blank[n - 1 :]) if n == 2 else ~blank[1 : len(b) - n + 2]
            if n == 4:
                good = good & ~blank[2 : len(b) - 1]
            at = np.flatnonzero(good)
            places.append(at)
            buckets.append((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2))
    return (np.concatenate(places), np.concatenate(buckets)) if places else (np.empty(0, np.int64), np.empty(0, np.uint32))


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  #: buckets x dimensions
    weights: np.ndarray  #: dimensions x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of the features of texts (or single words) that LETTERS has translated."""
        data = b" " + b" ".join(texts) + b" "
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = ends - [len(t) for t in texts]
        short = len(self.languages) <= self.embeddings.shape[1]
        lookup = (self.embeddings @ self.weights).astype(np.float32) if short else self.embeddings
        total, count = np.zeros((len(texts), lookup.shape[1])), np.zeros(len(texts))
        places, buckets = features(data)
        cut = np.append(np.flatnonzero(np.diff(places) < 0) + 1, len(places))
        a = 0
        for b in cut.tolist():  # one n at a time, in order of place
            edges = np.searchsorted(places[a:b], begins - 1)
            sizes = np.diff(np.append(edges, b - a))
            some = sizes > 0
            if some.any():
                total[some] += np.add.reduceat(lookup[buckets[a:b]], edges[some], axis=0)
            count += sizes
            a = b
        return total, count

    def logits_of(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if len(self.languages) <= self.embeddings.shape[1] else mean @ self.weights) + self.bias

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts that LETTERS has translated."""
        return self.logits_of(*self.sums(texts))

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Trains on a bounded list of rows; every CALIBRATE-th calibrates. No rows: a model without languages."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    w, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages))
    y = np.array([languages.index(x) for x in labels], np.int64)
    clean = [t.encode("utf-8", "ignore").translate(LETTERS) for t in texts]
    apart = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1
    rows = []
    for t in clean:
        buckets, n = np.unique(features(b" " + t + b" ")[1], return_counts=True)
        rows.append((buckets, (n / max(1, n.sum())).astype(np.float32)))
    order = np.flatnonzero(~apart)
    steps = max(1, EPOCHS * len(order))
    for step in range(steps if len(order) and len(languages) > 1 else 0):
        if step % len(order) == 0:
            rng.shuffle(order)
        k = order[step % len(order)]
        buckets, share = rows[k]
        if not len(buckets):
            continue
        rate = RATE * (1 - step / steps)
        hidden = share @ e[buckets]
        z = hidden @ w + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[k]] -= 1
        back = w @ p
        w -= (rate * np.outer(hidden, p)).astype(np.float32)
        bias -= 0.01 * rate * p
        e[buckets] -= (rate * np.outer(share, back)).astype(np.float32)
    model = Model(languages, e, w, bias)
    test = np.flatnonzero(apart)
    if len(test) and len(languages) > 1:
        z = np.concatenate([model.logits([clean[k]]) for k in test])

        def p_at(t):
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            return p / p.sum(1, keepdims=True)

        loss = {t: -np.log(np.maximum(p_at(t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in np.geomspace(1, 10, 30)}
        model.temperature = float(min(loss, key=loss.get))
        p = p_at(model.temperature)
        right = p.argmax(1) == y[test]
        if right.any():
            low = np.quantile(p.max(1)[right], LOST, method="lower")
            model.threshold = float(low if right.sum() * LOST >= 1 else MARGIN * low)
    return model


def train(df: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fits a model on a sample of the labelled rows of df, bounded by ROWS_PER_LANGUAGE, LANGUAGES and ROW_BYTES.

    Rows are chosen by a hash of their text, evenly within each language. Rows with a null text or label are left out, repeated rows count each,
    and without rows the model knows no language. With more than LANGUAGES labels the model learns the most frequent ones (ties by name): the
    others are never predicted, and their texts are rejected if the model is unsure of them. Raise LANGUAGES for more.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(label).cast("string").alias("y"), F.col(text).cast("string").alias("t")).where(F.col("y").isNotNull() & F.col("t").isNotNull() & (F.octet_length("t") <= ROW_BYTES))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(LANGUAGES).collect()}
    if not counts:
        return fit([], [])
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(steps, int(steps * ROWS_PER_LANGUAGE / n)))])
    got = rows.where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(steps)) < share[F.col("y")]).collect()
    got.sort(key=lambda r: (hash_of(r["t"]), r["y"]))
    return fit([r["t"] for r in got], [r["y"] for r in got])


def hash_of(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds lang_pred, score (the probability of the prediction, 0 where there is none) and rejected (below the threshold, or ``und``).

    A null text or one without a letter gets ``und``; of equally likely languages the first in alphabetical order is predicted. Rows stay as
    they are (repeated rows too, an empty table gives none). keep: the columns to carry (all); one with a name of the new ones is replaced.
    """
    prepare(df.sparkSession)
    row, back = carried(df, df.columns if keep is None else keep, list(names))
    frame = df.select(F.col(text).cast("string").alias("text"), row)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x dimensions

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in in_pieces(batches, 0, BYTES):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            clean = [t.encode().translate(LETTERS) for t in texts]
            known = np.array([bool(c.strip()) and (c.isascii() or has_letter(t)) for c, t in zip(clean, texts, strict=True)]) & bool(m.languages)
            found, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                p = m.probabilities([c for c, k in zip(clean, known, strict=True) if k])
                found[known], score[known] = np.array(m.languages, object)[p.argmax(1)], p.max(1)
            rejected = ~known | (score < m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string()), pa.array(score), pa.array(rejected)], ["row", *names])

    return back(frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """crc32 of the key as text, modulo parts, is part."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == part


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = predict(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out
