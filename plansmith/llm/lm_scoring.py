"""Language-model scores: subword lattice likelihoods.

A text is its words (ASCII in lower case, between white space) and an end. Its lattice has an arc for every piece of an existing vocabulary that
fits; the log-space forward recursion sums all segmentations. The pieces' weights are what the vocabulary's scores make of a unigram model, as a
prior, to which the counts expected over all segmentations of the training words are added.

Two more kinds of arcs span a whole word: its discounted count in the training texts, from which pieces get the discounted mass, and a copy of
an earlier word of the same text. Pieces with a blank begin words and none goes over a blank, so the recursion passes a node between words, and
what lies between two such nodes depends on the word alone: it is summed once for each different word. Weights and counts are kept by class of
text (the languages that a classifier on a bounded sample knows), a second coordinate of the nodes; a text's probability is the mean over classes
by their share. At every node the arcs' probabilities add up to 1 at most, and so do those of all texts.

Training words are counted over all training texts: each shard of texts sends its different words once, packed by bucket; buckets add the
counts up, score their words, and answer every shard with the scores of its words. No table of words is sent to all workers.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import cut, prepare, release, table
from plansmith.llm.language_id import LETTERS, Model, held_out, train
from plansmith.llm.lattice import Lattice, Vocabulary, batches, long_batches
from plansmith.llm.pretokens import span_hashes

#: Bytes of text in a shard (fewer with more than CLASSES classes), bytes of text whose words meet in a bucket; rounds of expected counts.
SHARD, BUCKET, CLASSES, ROUNDS = 24 << 20, 24 << 20, 6, 2
#: Highest share of copies, words after which half of it is reached.
COPIES, WARM = 0.15, 20
#: Words whose features are summed at once.
WORDS = 50_000
#: Bytes of text that are split into words at once.
BYTES = 1 << 19
#: A-Z to a-z, white space (0x20, 0x09-0x0D) to blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def _pack(array: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype, columns: int = 0) -> np.ndarray:
    import pyarrow as pa

    out = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype)
    return out.reshape(-1, columns) if columns else out


def _pack_words(words: list[bytes]) -> bytes:
    return _pack(np.frombuffer(b" ".join(words), np.uint8))


def _unpack_words(data: bytes) -> list[bytes]:
    return _unpack(data, np.uint8).tobytes().split()


def classes_of(model: Model, words: list[bytes], docs: list[np.ndarray]) -> np.ndarray:
    """Numbers of the classes of texts given as numbers of their words; features don't go over words, so each word's are summed once."""
    if len(model.languages) < 2:
        return np.zeros(len(docs), np.int64)
    parts = [model.sums([w.translate(LETTERS) for w in words[a : a + WORDS]]) for a in range(0, len(words), WORDS)]
    total, count = (np.concatenate(x).astype(np.float32) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, 1)), np.zeros(0))
    sums = np.array([total[d].sum(0) for d in docs])
    return model.logits_of(sums, np.array([count[d].sum() for d in docs])).argmax(1)


def _numbered(texts: list[str], count: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The different words of texts by bucket (of their 64-bit hashes, in their order), and every text as numbers of words in that order."""
    hashes, words, where, sizes = [], [], [], []
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < BYTES):
            raw.append(texts[at].encode("utf-8", "surrogatepass").translate(LOWER))
            size, at = size + len(raw[-1]), at + 1
        whole = b" " + b" ".join(raw) + b" "
        data = np.frombuffer(whole, np.uint8)
        blank = data == 32
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        sizes.append(np.diff(np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))))
        h, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        words += [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        hashes.append(h)
        where.append(inverse + sum(map(len, hashes[:-1])))
    if not texts:
        return [[] for _ in range(count)], []
    h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    bucket = (h % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    named = [words[i] for i in first[order].tolist()]
    edges = np.searchsorted(bucket[order], np.arange(count + 1)).tolist()
    numbers = place[inverse[np.concatenate(where)]] if len(h) else np.empty(0, np.int64)
    return [named[a:b] for a, b in zip(edges, edges[1:], strict=False)], np.split(numbers, np.cumsum(np.concatenate(sizes))[:-1])


def score(df: DataFrame, learn, key: str, file: str, text: str = "text", label: str | None = "lang") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; all scores are log10.

    learn: a condition, the rows to learn from; rows where it is null aren't held out. A null text counts as empty: one token, the end. Without
    rows to learn from, whole-word counts are 0 and the vocabulary's own scores remain. Repeated rows count and come out each; an empty table
    gives no rows. Only key, text, label and what learn names are used, so other columns' names don't matter.
    """
    spark = df.sparkSession
    prepare(spark)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lang = F.col(label).cast("string") if label and label in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), plain.alias("text"), lang.alias("lang"), (~F.coalesce(learn, F.lit(True))).alias("held"))
    model = train(rows.where("not held and lang is not null"), "text", "lang")
    k = max(1, len(model.languages))
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).head()[0] or 0
    count, buckets = (max(1, -(-size * max(k, CLASSES) // (CLASSES * most))) for most in (SHARD, BUCKET))
    texts = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(count)).cast("int").alias("shard"), "key", "held", "text").repartition(count, "shard")
    shared = spark.sparkContext.broadcast(model)  # of a fixed size

    def count_words(key_, group):
        import pyarrow as pa

        release()
        parts, docs = _numbered(group["text"].to_pylist(), buckets)
        kinds = np.where(np.asarray(group["held"]), k, classes_of(shared.value, [w for p in parts for w in p], docs))
        ends = np.bincount(kinds, minlength=k + 1)[:k]
        counts = np.zeros((sum(map(len, parts)), k), np.int64)
        for c in range(k):
            own = [d for d, x in zip(docs, kinds, strict=True) if x == c]
            if own:
                counts[:, c] = np.bincount(np.concatenate(own), minlength=len(counts))
        edges = np.cumsum([0, *map(len, parts)])
        out = [(b, key_[0].as_py(), _pack_words(p), _pack(counts[edges[b] : edges[b + 1]])) for b, p in enumerate(parts) if p]
        out.append((-1, key_[0].as_py(), b"", _pack(ends)))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "shard", "words", "counts"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    parts = cut(texts.groupBy("shard").applyInArrow(count_words, "bucket int, shard int, words binary, counts binary"))

    def add_up(key_, group):
        import pyarrow as pa

        release()
        total: dict[bytes, np.ndarray] = {}
        for words, counts in zip(group["words"].to_pylist(), group["counts"].to_pylist(), strict=True):
            for w, c in zip(_unpack_words(words), _unpack(counts, np.int64, k), strict=True):
                had = total.get(w)
                total[w] = c if had is None else had + c
        words = sorted(total)
        return pa.table({"bucket": pa.array([key_[0].as_py()], pa.int32()), "words": pa.array([_pack_words(words)], pa.binary()), "counts": pa.array([_pack(np.array([total[w] for w in words]))], pa.binary())})

    words = cut(parts.where("bucket >= 0").groupBy("bucket").applyInArrow(add_up, "bucket int, words binary, counts binary"))

    def ends_of(batches_):
        import pyarrow as pa

        total = np.zeros(k, np.int64)
        for batch in batches_:
            for c in batch.column(0).to_pylist():
                total += _unpack(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(range(k), pa.int32())], ["n", "what"])

    told = parts.where("bucket < 0").select("counts").mapInArrow(ends_of, "n bigint, what int").groupBy("what").agg(F.sum("n").alias("n")).collect()  # a row a class
    ends = np.zeros(k, np.int64)
    for r in told:
        ends[r["what"]] = r["n"]

    def sums(batches_):
        import pyarrow as pa

        for batch in batches_:
            for c in batch.column(0).to_pylist():
                n = _unpack(c, np.int64, k)
                yield pa.RecordBatch.from_arrays([pa.array([*n.sum(0).tolist(), *(n > 0).sum(0).tolist(), *((n.sum(1) == x).sum() for x in (1, 2)), int((n.sum(1) > 0).sum())]), pa.array(range(2 * k + 3), pa.int32())], ["n", "what"])

    summed = {r["what"]: r["n"] for r in words.select("counts").mapInArrow(sums, "n bigint, what int").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    n_class = np.array([summed.get(i, 0) for i in range(k)]) + ends
    v_class = np.array([summed.get(k + i, 0) for i in range(k)]) + (ends > 0)
    once, twice, some = (summed.get(2 * k + i, 0) for i in range(3))
    n_all, v_all = int(n_class.sum()), some + int(ends.sum() > 0)
    vocabulary = Vocabulary.read(file)
    weights = np.tile(vocabulary.weights(), (k, 1))
    for _ in range(ROUNDS if n_all else 0):
        weights = vocabulary.with_counts(_expected(words, vocabulary, weights, k), np.maximum(ends, 1))
    discount = once / (once + 2 * twice) if once and twice else 0.75  # from each word that was seen (the leaving-one-out estimate)
    known = {"n": n_all, "v": v_all, "n_class": n_class, "v_class": v_class, "ends": ends, "discount": discount, "p_end": np.exp(weights[:, -1])}
    fixed = spark.sparkContext.broadcast((vocabulary, weights))  # the vocabulary's size

    def answer(_, asked, counted):
        import pyarrow as pa

        if not counted.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "base": pa.array([], pa.binary()), "logs": pa.array([], pa.binary())})
        names, counts = _unpack_words(counted["words"][0].as_py()), _unpack(counted["counts"][0].as_py(), np.int64, k)
        base, logs = word_scores(Lattice(*fixed.value), names, counts, known)
        place = {w: i for i, w in enumerate(names)}
        out = []
        for b, s, x in zip(asked["bucket"].to_pylist(), asked["shard"].to_pylist(), asked["words"].to_pylist(), strict=True):
            at = np.array([place[w] for w in _unpack_words(x)])
            out.append((s, b, _pack(base[at]), _pack(logs[at].astype(np.float32))))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "bucket", "base", "logs"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    answers = parts.where("bucket >= 0").groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer, "shard int, bucket int, base binary, logs binary")

    def add_scores(_, group, told):
        import pyarrow as pa

        release()
        _, docs = _numbered(group["text"].to_pylist(), buckets)
        rows_ = sorted(zip(told["bucket"].to_pylist(), told["base"].to_pylist(), told["logs"].to_pylist(), strict=True))
        base = np.concatenate([_unpack(b, np.float64) for _, b, _ in rows_] or [np.empty(0)])
        logs = np.concatenate([_unpack(x, np.float32, k) for _, _, x in rows_] or [np.empty((0, k), np.float32)])
        out = [text_scores(d, base, logs, known) for d in docs]
        n, seen, b, s = zip(*out, strict=True)
        arrays = [group["key"], group["held"], pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array([n_all] * len(docs), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())]
        return pa.Table.from_arrays(arrays, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(add_scores, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _expected(words: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, k: int) -> np.ndarray:
    """Expected counts of the pieces over all different training words, added up by piece: at most classes x pieces rows."""
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches_):
        import pyarrow as pa

        lattice, total = Lattice(*shared.value), np.zeros((k, len(vocabulary.pieces)))
        for batch in batches_:
            for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, seen = _unpack_words(names), (_unpack(counts, np.int64, k) > 0).astype(float)
                for at in chain(batches(names), long_batches(names)):
                    total += lattice.expected([names[i] for i in at], seen[at])
        release()
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p), pa.array(total[c, p])], ["c", "p", "n"])

    got = words.select("words", "counts").mapInArrow(run, "c bigint, p bigint, n double").groupBy("c", "p").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((k, len(vocabulary.pieces)))
    out[got["c"].to_numpy(np.int64), got["p"].to_numpy(np.int64)] = got["n"]
    return out


def between(counts: np.ndarray, spelled: np.ndarray, known: dict) -> np.ndarray:
    """Natural logs by class of all arcs but copies between two nodes: by counts of words (words x classes) and by logs of their pieces' sums.

    The discounted mass of a class goes to the counts of all classes, theirs to the pieces. Without counts, pieces have it all.
    """
    logs, d = spelled, known["discount"]
    if not known["n"]:
        return logs
    total = counts.sum(1)
    with np.errstate(divide="ignore"):
        logs = np.logaddexp(np.log(np.maximum(total - d, 0) / known["n"])[:, None], math.log(d * known["v"] / known["n"]) + logs)
        for c, (n, v) in enumerate(zip(known["n_class"], known["v_class"], strict=True)):
            if n:
                logs[:, c] = np.logaddexp(np.log(np.maximum(counts[:, c] - d, 0) / n), math.log(d * v / n) + logs[:, c])
    return logs


def word_scores(lattice: Lattice, names: list[bytes], counts: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the add-one estimate; natural logs by class of all arcs but copies) of words."""
    base = np.log10((counts.sum(1) + 1) / (known["n"] + known["v"] + 1))
    return base, between(counts, lattice.scores(names) - np.log1p(-np.minimum(known["p_end"], 0.999)), known)


def text_scores(words: np.ndarray, base: np.ndarray, logs: np.ndarray, known: dict) -> tuple[int, int, float, float]:
    """(tokens, known tokens, base score, score) of a text given as numbers of its words: the forward recursion from node to node."""
    n, ends = len(words), known["ends"]
    end_base = math.log10((ends.sum() + 1) / (known["n"] + known["v"] + 1))
    unseen = math.log10(1 / (known["n"] + known["v"] + 1))
    own = base[words]
    seen = int((own > unseen + 1e-12).sum()) + int(ends.sum() > 0)
    order = np.argsort(words, kind="stable")
    new = np.append(True, words[order][1:] != words[order][:-1]) if n else np.empty(0, bool)
    before = np.empty(n)
    before[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    at = np.arange(n)
    copy = COPIES * at / (at + WARM)
    with np.errstate(divide="ignore"):
        p = np.logaddexp(np.log1p(-copy)[:, None] + logs[words].astype(np.float64), np.log(copy * before / np.maximum(at, 1))[:, None]).sum(0)
    p = p + math.log1p(-COPIES * n / (n + WARM)) + between(ends[None, :], np.log(known["p_end"])[None, :], known)[0] + np.log((ends + 0.5) / (ends + 0.5).sum())
    top = p.max()
    return n + 1, seen, float(own.sum() + end_base), float((top + math.log(np.exp(p - top).sum())) / math.log(10))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that aren't held out."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), ~held_out(parts=7), "doc_id", public_tokenizers.path("piece_bpe_32k.model"))
