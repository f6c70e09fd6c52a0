"""From documents to packed training sequences: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs, but for the last, which returns the packed pieces. Rows with a null text
have no language and go in the first stage. Every stage takes any columns besides doc_id and text, and gives no rows for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from plansmith.llm.common import cut, shared_dir, table

#: Near duplicates: words of a shingle, percent of similarity.
WORDS, SIMILAR = 5, 80


def _apart(docs: DataFrame) -> DataFrame:
    """The text, and all columns in one, so that their names don't matter to the operators."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"), F.col("text"))


def _back(df: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of docs; with a text from another column, n_chars is made to match."""
    new = {}
    if text:
        new["text"] = F.col(text)
        if "n_chars" in docs.columns:
            new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[(new[c] if c in new else F.col(f"whole.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on a bounded sample of their labels, doesn't reject.

    Null texts and those without a letter go; repeated rows are judged alike. Without any label all documents go.
    """
    return _back(language_id.predict(_apart(docs), language_id.train(docs), keep=["whole"]).where("not rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows of one id are judged each by its text, repeated rows of an id and a text become one.

    Null and wordless texts are like no other and stay, once for each id; a null id is an id like others.
    """
    return ngram_join.without_near_duplicates(docs, words=WORDS, similar=SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 200-byte strings that occur twice; one that is nothing else goes, and so do all copies of a text of that size.

    Null texts stay and become empty, empty and short ones stay as they are.
    """
    left = suffix_dedup.remove_repeated(_apart(docs), ["whole"], with_text=True).where("n_removed = 0 or trim(kept) <> ''")
    return _back(left, docs, "kept")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of ten benchmark words; one that is nothing else goes. Null and empty texts stay; repeated rows stay repeated."""
    clean = decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark"), ["whole"], cleaned="clean")
    return _back(clean.where("n_hit = 0 or n_hit < n_words"), docs, "clean")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; a null or empty text is its end id, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(cut(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("language_id", languages),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]

#: No SQL for the classifier and the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each stage's result written to the shared folder and read again; what was read is removed then.

    The last stage cuts its lineage itself, so its input, which a lost executor doesn't need again, is all that is left of the folder.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
