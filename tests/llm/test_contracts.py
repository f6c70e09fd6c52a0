"""Columns with clashing names, repeated ids, long texts, and the query functions themselves against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F
from test_llm import FILE, SCHEMA, _links, _shingles, library, words

import corpus_pipeline
from plansmith.llm import chat_format, components, cover_tree, decontaminate, language_id, lattice, lm_scoring, ngram_join, packing, queries, suffix_dedup, token_counts, token_files
from plansmith.llm.common import cut

#: Names that operators use or used for columns of their own.
CLASHING = "h1 h2 n_bytes n_removed n_spans kept kept_sha256 n_hit n_words n_items items_sha256 contaminated spans clean n_tokens base part place row key at set n root token shard held __held __text __at lang_pred score rejected whole least h k v label_ rows".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [words(rng, rng.randint(20, 120), 300) for _ in range(14)]
    return [*base, base[0], base[1] + " more", base[2] + " " + base[3], None, "", "12 !!", base[4].upper()]


@pytest.fixture(scope="module")
def plain(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de"][i % 2], "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).cache()


@pytest.fixture(scope="module")
def wide(plain):
    return plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING]).cache()


def same(a, b, *columns):
    form = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert form(a) == form(b)


def test_clashing_columns_of_operators(spark, plain, wide):
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.remove_repeated(wide, ["doc_id", *CLASHING], length=48)
    same(got, suffix_dedup.remove_repeated(plain, ["doc_id"], length=48), "doc_id", *added)
    assert len(set(got.columns)) == len(got.columns) and {r.h1 for r in got.select("h1").collect()} == {f"h1-{i}" for i in range(plain.count())}
    bench = spark.createDataFrame([("i", "w1 w2 w3"), ("j", None)], "item_id string, text string")
    got = decontaminate.decontaminate(wide, bench, ["doc_id", *CLASHING], cleaned="clean")
    same(got, decontaminate.decontaminate(plain, bench, ["doc_id"], cleaned="clean"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "clean")
    same(got.select("doc_id", "h1"), wide, "doc_id", "h1")
    got = token_counts.count_tokens(wide, FILE, keep=("doc_id", *CLASHING))
    same(got, token_counts.count_tokens(plain, FILE), "doc_id", "n_tokens")
    model = language_id.train(plain)
    same(language_id.predict(wide, model), language_id.predict(plain, model), "doc_id", "lang_pred", "score", "rejected")
    same(ngram_join.near_duplicates(wide), ngram_join.near_duplicates(plain), "doc_id", "n_shingles", "component_id")
    same(packing.pack(cut(packing.pieces(wide, FILE))), packing.pack(cut(packing.pieces(plain, FILE))), "doc_id", "piece", "start", "length", "ids_crc32")
    import public_tokenizers

    learn, file = ~language_id.held_out(parts=7), public_tokenizers.path("piece_bpe_32k.model")
    same(lm_scoring.score(wide, learn, "doc_id", file), lm_scoring.score(plain, learn, "doc_id", file), "doc_id", "n_tokens", "n_known", "train_tokens")


def test_clashing_columns_of_token_files_chats_and_vectors(spark, wide, plain, tmp_path):
    a, b = (token_files.read_files(spark, str(tmp_path / n), token_files.write_files(d, FILE, str(tmp_path / n))) for n, d in (("a", wide), ("b", plain)))
    same(a, b, "doc_id", "start", "n_tokens", "ids_crc32")
    chats = spark.createDataFrame([(1, 0, "user", "0"), (1, 0, "user", "<"), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    more = chats.select("*", *[F.lit("x").alias(c) for c in ("t", "turns", "blocks", "conv", "formatted", "mask")])
    same(chat_format.format_chats(more), chat_format.format_chats(chats), "conv_id", "formatted", "mask")
    (told,) = chat_format.read_back(chat_format.format_chats(chats)).collect()
    assert [t.text for t in told.turns] == ["0", "<", "x"]  # ties by the text as it is, not as it is escaped
    vectors = spark.createDataFrame([(i, [1.0, i % 3 * 0.1, 0.0], 1) for i in range(12)], "vec_id long, embedding array<float>, label int")
    more = vectors.select("*", *[F.lit("x").alias(c) for c in ("group", "v", "rep", "n", "cell", "guest", "salt", "k")])
    same(cover_tree.near_vectors(more), cover_tree.near_vectors(vectors), "vec_id", "n_links", "component_id", "kept")


def test_stages_keep_clashing_columns(spark, wide):
    docs = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        got = {r.doc_id: tuple(r[c] for c in CLASHING) for r in out.collect()}
        assert got and all(v == tuple(f"{c}-{k}" for c in CLASHING) for k, v in got.items()), name
        docs = cut(out)
    assert stage(spark, docs, DATA).count()


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (words(random.Random(i), 60, 900) for i in range(3))
    rows = [(1, a, "x", "s", 1), (2, a, "x", "s", 1), (2, b, "x", "s", 1), (3, c, "x", "s", 1), (3, c, "x", "s", 1), (None, a + " z", "x", "s", 1), (None, None, "x", "s", 1), (4, "", "x", "s", 1)]
    got = sorted(str((str(r.doc_id), r.text)) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect())
    assert got == sorted(map(str, [("None", a + " z"), ("2", b), ("3", c), ("None", None), ("4", "")]))


def test_long_texts(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(words(rng, 2000, 5000) for _ in range(140)) + "x" * 300_000
    d = spark.createDataFrame([(1, long, "en", "s", 1), (2, "short", "en", "s", 1)], SCHEMA)
    ids = {k: [*library().encode(t, add_special_tokens=False).ids, 0] for k, t in ((1, long), (2, "short"))}
    assert len(long) > 1 << 20
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, FILE).collect()} == {k: len(x) - 1 for k, x in ids.items()}
    read = token_files.read_files(spark, str(tmp_path), token_files.write_files(d, FILE, str(tmp_path))).collect()
    assert {r.doc_id: r.ids_crc32 for r in read} == {k: zlib.crc32(np.array(x, "<u4").tobytes()) for k, x in ids.items()}
    p = packing.pieces(d, FILE, with_ids=True).where("doc_id = 1").orderBy("piece").collect()
    assert np.frombuffer(b"".join(r.ids for r in p), "<u4").tolist() == ids[1]
    twice = d.unionByName(d.where("doc_id = 1").select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("head "), "text").alias("text"), "lang", "source", "n_chars"))
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated(twice, ["doc_id"]).collect()}
    assert removed[1] == len(long) and removed[3] == len(long) and removed[2] == 0
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(twice).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_token_queries(spark, documents):
    ids = {k: library().encode(r.text or "", add_special_tokens=False).ids for k, r in documents.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op6_token_counts"](spark, DATA).collect()}
    assert got == {k: (len((documents[k].text or "").encode()), len(x), len(x) > 512) for k, x in ids.items()}
    start, want = 0, {}
    for k in sorted(ids):
        all_ids = np.array([*ids[k], 0], "<u4")
        want[k] = (start, len(all_ids), zlib.crc32(all_ids.tobytes()))
        start += len(all_ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op7_token_files"](spark, DATA).collect()} == want
    pieces = queries.QUERIES["op2_best_fit_packing"](spark, DATA).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert pieces.sequence_id.nunique() <= -(-start // 2048) * 1.01 + 2
    for k, own in pieces.sort_values("piece").groupby("doc_id"):
        flat = np.array([*ids[k], 0], "<u4")
        assert own.start.tolist() == np.append(0, np.cumsum(own.length)[:-1]).tolist() and own.length.sum() == len(flat)
        assert [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
        assert (own.length[1:] == 2048).all() and (len(own) == 1 or len(flat) > 2048)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, np.cumsum(own.length)[:-1]).tolist()


def test_ngram_query(spark, documents):
    sets = {k: _shingles(r.text, 4) for k, r in documents.items()}
    root = components.forest_of(_links(sets, 85))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op9_ngram_join"](spark, DATA).collect()}
    assert got == {k: (len(s), root.get(k, k)) for k, s in sets.items()}


def _repeats(texts, length):
    """n_bytes, n_removed, n_spans, what is left."""
    seen = collections.Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    for k, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()


def test_suffix_query(spark, documents):
    want = {k: (n, gone, spans, hashlib.sha256(left).hexdigest()) for k, n, gone, spans, left in _repeats({k: (r.text or "").encode() for k, r in documents.items()}, 200)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op10_suffix_dedup"](spark, DATA).collect()} == want


def test_language_query(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, DATA).collect()}
    assert set(got) == set(documents)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    test = [k for k, r in documents.items() if got[k].held_out and r.lang and r.text and any(c.isalpha() for c in r.text)]
    assert sum(got[k].lang_pred == documents[k].lang for k in test) >= 0.97 * len(test)
    assert {got[k].lang_pred for k, r in documents.items() if not r.text or not any(c.isalpha() for c in r.text)} <= {"und"}


def test_lm_query(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op1_lm_scoring"](spark, DATA).collect()}
    assert set(got) == set(documents)
    tokens = {k: [*(r.text or "").encode().lower().split(), None] for k, r in documents.items()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in documents}
    c = collections.Counter(w for k, t in tokens.items() if not out[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t) and r.score < 0


def _segmentations(text, ids):
    """All ways to write text with pieces."""
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in ids:
            for rest in _segmentations(text[n:], ids):
                yield (ids[text[:n]], *rest)


def test_lm_scores_by_brute_force(spark, monkeypatch):
    vocabulary = lattice.Vocabulary([b" ", b" a", b"a", b"ab", b"b", b"bab", b" b"] + [bytes([k]) for k in range(99, 104)], np.arange(12))
    monkeypatch.setattr(lattice.Vocabulary, "read", classmethod(lambda cls, file: vocabulary))
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("aabbc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    rows = [(i, t, None, "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 4 != 0, "doc_id", "none").collect()}
    ids = {p: i for i, p in enumerate(vocabulary.pieces)}
    train = [texts[i].encode().split() for i in range(40) if i % 4]
    c = collections.Counter(w for t in train for w in t)
    ends = len(train)
    weights = vocabulary.prior()
    for _ in range(lm_scoring.ROUNDS):
        expected = np.zeros(len(weights))
        for w in c:
            ways = list(_segmentations(b" " + w, ids))
            p = np.array([np.prod(weights[list(s)]) for s in ways])
            for s, x in zip(ways, p / p.sum(), strict=True):
                np.add.at(expected, list(s), x)
        expected[-1] = ends
        weights = expected + lattice.PRIOR * vocabulary.prior()
        weights /= weights.sum()
    n, v = sum(c.values()) + ends, len(c) + 1
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)

    def arcs(count, pieces):  # the one class has the counts of all
        every = max(count - d, 0) / n + d * v / n * pieces
        return max(count - d, 0) / n + d * v / n * every

    for i, t in enumerate(texts):
        p, own = 1.0, t.encode().split()
        for j, w in enumerate(own):
            copy = lm_scoring.COPIES * j / (j + lm_scoring.WARM)
            spelled = sum(np.prod(weights[list(s)]) for s in _segmentations(b" " + w, ids)) / (1 - weights[-1])
            p *= (1 - copy) * arcs(c[w], spelled) + copy * own[:j].count(w) / max(j, 1)
        p *= (1 - lm_scoring.COPIES * len(own) / (len(own) + lm_scoring.WARM)) * arcs(ends, weights[-1])
        assert abs(got[i] - np.log10(p)) < 1e-5 * max(1, abs(np.log10(p)))


@pytest.mark.parametrize("n", [0, 90])
def test_mass_between_nodes_is_one_at_most(n):
    vocabulary = lattice.Vocabulary([b" ", b" a", b"a", b"ab", b"b", b" b"], np.arange(6))
    tree, weights = lattice.Lattice(vocabulary, np.tile(vocabulary.weights(), (2, 1))), vocabulary.prior()
    every = [b""]
    for _ in range(12):
        every += [w + x for w in every[-(2 ** (len(every).bit_length() - 1)) :] for x in (b"a", b"b")]
    every = sorted({w for w in every if w})
    counts = np.zeros((len(every), 2), np.int64)
    counts[:20, 0] = n // 30  # the second class has no counts at all
    ends = np.array([n // 3, 0])
    total = counts.sum(0) + ends
    known = {"n": int(total.sum()), "v": 21 if n else 0, "n_class": total, "v_class": np.array([21 if n else 0, 0]), "ends": ends, "discount": 0.6, "p_end": np.array([weights[-1]] * 2)}
    _, logs = lm_scoring.word_scores(tree, every, counts, known)
    end = lm_scoring.between(ends[None, :], np.log(known["p_end"])[None, :], known)[0]
    mass = np.exp(logs).sum(0) + np.exp(end)
    assert (mass <= 1 + 1e-9).all() and (mass > 0.5).all()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage's rows from what the stage before kept."""
    rng = random.Random(21)
    base = [" ".join(rng.choice(("alpha beta gamma delta", "eins zwei drei vier")[i % 2].split()) + str(rng.randint(0, 400)) for _ in range(90)) for i in range(40)]
    edited = base[0].split()
    edited[45] = "changed"
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text]
    texts = [*base, base[1], " ".join(edited), base[2] + " " + " ".join(base[3].split()[:60]), base[4] + " " + bench[0], None, "12 34"]
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2] if i < 40 else None, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    model = language_id.train(docs)
    one = corpus_pipeline.languages(spark, docs, DATA)
    p = {i: model.probabilities([t.encode().translate(language_id.LETTERS)]).max() for i, t in enumerate(texts) if t and language_id.has_letter(t)}
    assert {r.doc_id for r in one.collect()} == {i for i, x in p.items() if x >= model.threshold}
    one = docs.where("text is not null and doc_id <> 45").cache()
    sets = {r.doc_id: _shingles(r.text, 5) for r in one.collect()}
    root = components.forest_of(_links(sets, 80))
    two = cut(corpus_pipeline.near_duplicates(spark, one, DATA))
    assert {r.doc_id for r in two.collect()} == {k for k in sets if root.get(k, k) == k} and 41 in root
    left = {k: rest.decode("utf-8", "ignore") for k, _, gone, _, rest in _repeats({r.doc_id: r.text.encode() for r in two.collect()}, 200) if not gone or rest.strip()}
    three = cut(corpus_pipeline.repeated_passages(spark, two, DATA))
    assert {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {k: (t, len(t)) for k, t in left.items()}
    four = {r.doc_id: r.text for r in corpus_pipeline.benchmark_passages(spark, three, DATA).collect()}
    windows = {tuple(w[i : i + 10]) for b in bench for w in [decontaminate.words_of(b)] for i in range(max(1, len(w) - 9)) if w}
    for k, t in left.items():
        w = decontaminate.words_of(t)
        hit = {p for size in {len(x) for x in windows} for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for p in range(i, i + size)}
        assert (decontaminate.words_of(four[k]) == [x for i, x in enumerate(w) if i not in hit]) if len(hit) < len(w) else k not in four
    packed = corpus_pipeline.packed(spark, cut(spark.createDataFrame(list(four.items()), "doc_id long, text string")), DATA).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.groupby("doc_id").length.sum().to_dict() == {k: len(library().encode(t, add_special_tokens=False).ids) + 1 for k, t in four.items()}
