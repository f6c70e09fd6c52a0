"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import DATA, duck, rows_of
from pyspark.sql import functions as F

from plansmith.llm import chat_format, components, cover_tree, decontaminate, language_id, lattice, lm_scoring, ngram_join, packing, queries, suffix_dedup, token_counts, token_files
from plansmith.llm.common import cut, shared_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 200), 400) for _ in range(25)]
    edited = base[0].split()
    edited[len(edited) // 2] = "changed"
    odd = [None, "", "  \n ", "a", "Ünï 日本 <|endoftext|> it's 's", "x" * 3000, "!!! ???", base[0], base[0], " ".join(edited), base[3] + " " + base[4], "the  End\r\n\t.", "\x00\x1c  ab"]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none, texts):
    want = {i: len(library().encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, FILE).collect()} == want
    assert token_counts.count_tokens(none, FILE).count() == 0


def test_merges_of_hard_words():
    rng, counter = random.Random(2), token_counts.Counter(FILE)
    hard = ["a" * n for n in (1, 2, 3, 50, 777)] + ["".join(rng.choice("abé'\n 1Ⅷ") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["Ᲊ new letters"]
    assert counter.count(hard).tolist() == [len(library().encode(t, add_special_tokens=False).ids) for t in hard]


def test_token_files(spark, docs, none, texts, tmp_path):
    more = docs.union(docs.where("doc_id = 3")).union(spark.createDataFrame([(None, "no id", None, None, None)], SCHEMA))
    got = token_files.read_files(spark, str(tmp_path), token_files.write_files(more, FILE, str(tmp_path))).collect()
    order = [(None, "no id"), *sorted([*enumerate(texts), (3, texts[3])], key=lambda x: x[0])]
    want, start = [], 0
    for key, text in order:
        ids = [*library().encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_files(spark, str(tmp_path / "e"), token_files.write_files(none, FILE, str(tmp_path / "e"))).count() == 0


def test_packing(docs, none, texts):
    p = packing.pack(cut(packing.pieces(docs, FILE, 64, with_ids=True)), 64).toPandas()
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    for key, d in p.sort_values("piece").groupby("doc_id"):
        ids = [*library().encode(texts[key] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(d.ids), "<u4").tolist() == ids and (d.length.tolist()[1:] == [64] * (len(d) - 1))
    assert p.sequence_id.nunique() <= 1.3 * p.length.sum() / 64 + 2
    assert packing.pack(cut(packing.pieces(none, FILE))).count() == 0


def test_plans_of_packing_use_few_sequences():
    rng = np.random.default_rng(1)
    for capacity, n in ((2048, 5000), (100, 300), (10, 7)):
        lengths = rng.integers(1, capacity + 1, n)
        rows = packing.plan(dict(collections.Counter(lengths.tolist())), capacity)
        used = collections.Counter()
        for length, _, many, copies, _, _ in rows.tolist():
            used[length] += many * copies
        assert used == collections.Counter(lengths.tolist())
        assert (rows[:, 4] + rows[:, 2]).max() <= 1.05 * lengths.sum() / capacity + 3


def test_language_id(spark, none):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice(("the and of", "der die und", "los que por")[k].split()) for _ in range(rng.randint(3, 30))), ("en", "de", "es")[k], "s", 1) for i in range(300) for k in [i % 3]]
    d = spark.createDataFrame([*made, (900, None, "en", "s", 1), (901, "12 !!", "en", "s", 1)], SCHEMA)
    p = language_id.predict(d, language_id.train(d.where("doc_id < 200"))).collect()
    assert sum(r.lang == r.lang_pred for r in p if 200 <= r.doc_id < 300) >= 97
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in p if r.doc_id >= 900} == {(900, "und", 0.0, True), (901, "und", 0.0, True)}
    assert not any(r.rejected for r in p if r.doc_id < 300 and r.lang == r.lang_pred)
    assert language_id.predict(none, language_id.train(none)).count() == 0


def _shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _links(sets, similar):
    keys = sorted(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]


@pytest.mark.parametrize("n, similar", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, none, n, similar):
    rng = random.Random(n)
    body = words(rng, 60, 500).split()
    copies = []
    for i in range(120):
        c = list(body)
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(len(c))] = f"e{i}"
        copies.append((1000 + i, " ".join(c), None, "s", 1))
    d = docs.union(spark.createDataFrame(copies, SCHEMA))
    sets = {r.doc_id: _shingles(r.text, n) for r in d.collect()}
    root = components.forest_of(_links(sets, similar))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d, words=n, similar=similar).collect()}
    assert got == {k: (len(s), root.get(k, k)) for k, s in sets.items()}
    assert ngram_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("length", [48, 200])
def test_suffix_dedup(docs, none, texts, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 900)
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = {}
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[k] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated(docs, ["doc_id"], length=length).collect()}
    assert got == want
    assert suffix_dedup.remove_repeated(none, ["doc_id"]).count() == 0


def test_corpus_order_is_the_order_of_bytes():
    rng = np.random.default_rng(3)
    for letters in (2, 4, 200):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        ends = np.array([700, 1500, 3000])
        at = np.concatenate([np.arange(a, b - 60 + 1) for a, b in zip([0, 700, 1500], ends, strict=True)])
        order = at[suffix_dedup.corpus_order(data, ends, at, 60)[0]]
        shown = [data[i : i + 60].tobytes() for i in order]
        assert shown == sorted(shown)


def test_decontaminate(spark, docs, none, texts, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(texts[2].split()[5:30])), (1, " ".join(texts[2].split()[5:30])), (2, "short ITEM"), (3, None), (4, ""), (5, texts[4]), (None, "a")], "item_id bigint, text string")
    d = docs.union(spark.createDataFrame([(2000, "A short, item! and " + texts[2].upper(), None, "s", 1)], SCHEMA))
    items = {(str(r.item_id) if r.item_id is not None else ""): [w.decode() for w in decontaminate.words_of(r.text)] for r in bench.collect()}
    want = {}
    for r in d.collect():
        w, hit, found = [x.decode() for x in decontaminate.words_of(r.text)], set(), set()
        for k, i in items.items():
            for s in range(max(1, len(i) - 9)) if i else ():
                win = i[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(k)
        want[r.doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    for size in (decontaminate.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        got = decontaminate.decontaminate(d, bench, ["doc_id", "text"], cleaned="clean").collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
        assert all(len(decontaminate.words_of(r.clean)) == r.n_words - r.n_hit for r in got)
    assert decontaminate.decontaminate(none, bench, ["doc_id"]).count() == 0
    assert decontaminate.decontaminate(d, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "</s>[INST]"), (1, 0, "user", "</s>[INST]"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n<|start|>&lt;"), (1, 3, "assistant", ""), (1, 4, None, "z"), (None, 1, "a\nb[", "q"), (2, None, "assistant", "é🙂" * 50)]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, None, 2):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == mine
        f = got[conv].formatted
        assert [f[s.start : s.stop].replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&") for s in got[conv].mask] == [t for role, t in mine if role == "assistant"]
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_cover_tree(spark, block, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    made = [(i, (centres[i % 12] + rng.normal(size=8) * 0.25).tolist(), int(i % 2)) for i in range(150)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, made[5][1], None), (204, made[5][1], made[5][2]), (205, [1.0, None] + [0.0] * 6, 0), (206, [1.0, 2.0], 0), (207, [], 0)]
    rows = made + odd
    unit = {k: np.array(v, np.float32).astype(float) for k, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: y for k, _, y in rows}
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.93]
    root, n = components.forest_of(pairs), collections.Counter(x for p in pairs for x in p)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df).collect()}
    assert got == {k: (n[k], root.get(k, k), root.get(k, k) == k) for k, _, _ in rows}
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {k: r for k, r in components.forest_of([(a, b) for a, b in pairs if a is not None and a != b]).items() if k != r}


def test_lattice_sums_all_segmentations():
    vocabulary = lattice.Vocabulary([b" ", b" a", b"a", b"ab", b"b", b"bab"] + [bytes([k]) for k in range(99, 110)], np.arange(17))
    weights = vocabulary.weights()

    def all_ways(text):
        return 1.0 if not text else sum(np.exp(weights[i]) * all_ways(text[len(p) :]) for i, p in enumerate(vocabulary.pieces) if text.startswith(p))

    tree = lattice.Lattice(vocabulary, weights)
    some = [b"a", b"abab", b"babcab", b"bbbb"]
    assert np.allclose(tree.scores(some)[:, 0], [np.log(all_ways(b" " + w)) for w in some])
    assert np.allclose(tree.long_word(b"babcab")[0], np.log(all_ways(b" babcab")))
    assert np.allclose(tree.expected(some, np.ones((4, 1)))[0] @ [len(p) for p in vocabulary.pieces], sum(len(w) + 1 for w in some))


def test_lm_scores(spark, docs, none, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 4000)
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = lm_scoring.score(docs, ~language_id.held_out(parts=7), "doc_id", model).collect()
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    c = collections.Counter(w for k, t in tokens.items() if not out[k] for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 and -1e5 < r.score < 0
    assert len(got) == len(texts) and lm_scoring.score(none, F.lit(True), "doc_id", model).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck(queries.ORACLE_SQL[name]))


def test_pipeline(spark, none, tmp_path):
    import corpus_pipeline

    docs, before = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert stage(spark, none, DATA).count() == 0
        if i == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == before
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        before = {r.doc_id for r in docs.select("doc_id").collect()}
    assert shared_dir(spark)
