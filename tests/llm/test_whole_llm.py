"""What the training-data operators must not leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.llm import language_id, lattice, lm_scoring
from plansmith.registry import table


def test_expected_counts_take_in_long_words(spark):
    vocabulary = lattice.Vocabulary([b" ", b" a", b"a", b"ab", b"b", b"bab"] + [bytes([k]) for k in range(99, 110)], np.arange(17))
    weights = np.tile(vocabulary.weights(), (2, 1))
    names = [b"ab", b"abbab" * 50, b"bacb" * 100, b"ba" * 96]
    assert [len(w) > lattice.LONG for w in names] == [False, True, True, False]
    seen = np.array([[1, 0], [2, 0], [1, 1], [0, 3]])
    words = spark.createDataFrame([(lm_scoring._pack_words(names), lm_scoring._pack(seen))], "words binary, counts binary")
    sizes = np.array([len(p) for p in vocabulary.pieces])
    got = lm_scoring._expected(words, vocabulary, weights, 2)
    # pieces cover each different word of a class, with its blank, exactly once
    assert np.allclose(got @ sizes, [sum(len(w) + 1 for w, s in zip(names, seen, strict=True) if s[c]) for c in (0, 1)])
    tree = lattice.Lattice(vocabulary, weights)
    for i in (1, 2):
        one = tree.expected([names[i]], np.ones((1, 2)))
        assert np.isclose(tree.forward([names[i]], 0, tree.arcs([names[i]]))[1][0], tree.long_word(names[i])[0])
        assert np.allclose(one[0], one[1])


def test_long_batches_bound_their_cells(monkeypatch):
    monkeypatch.setattr(lattice, "CELLS", 1000)
    names = [b"x" * n for n in (5, 2000, 200, 300, 250, 193, 192)]
    got = [b.tolist() for b in lattice.long_batches(names)]
    assert sorted(k for b in got for k in b) == [1, 2, 3, 4, 5]
    assert all(len(b) == 1 or len(b) * (max(len(names[k]) for k in b) + 1) <= 1000 for b in got)


@pytest.mark.parametrize("left_out", ["de", "es"])
def test_texts_of_a_language_left_out_of_training_go(spark, left_out):
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("lang is not null and text is not null and length(text) > 40").withColumn("new", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1)
    model = language_id.train(docs.where(F.col("lang") != left_out).where("not new"))
    out = language_id.predict(docs.where("new"), model, keep=["doc_id", "lang"]).collect()
    foreign, own = [r for r in out if r.lang == left_out], [r for r in out if r.lang == r.lang_pred]
    assert foreign and sum(r.rejected for r in foreign) >= 0.8 * len(foreign)
    assert sum(not r.rejected for r in own) >= 0.95 * len(own)
