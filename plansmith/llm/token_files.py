"""Token-id files: flat unsigned integers, 64-bit document offsets beside them, read back through memory maps.

A shard is one range of ids of documents in ascending order. Its files, all little-endian:
``N.ids`` the ids of all its documents in a row (16-bit where the vocabulary allows, else 32-bit), ``N.offsets`` 64-bit places where each
document starts and one more for the end, ``N.docs`` the documents' 64-bit ids. A manifest row gives each shard's counts; prefix sums over
the manifest give the shard's base: the ids of all documents before it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm.common import in_pieces, prepare, shared_dir, table

END_ID = 0
BYTES = 2 << 20


def _store(folder: str):
    """The file system and the path of a folder; other stores than a local disk go through pyarrow."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), folder) if "://" not in folder and not folder.startswith("file:") else fs.FileSystem.from_uri("file://" + folder.split(":", 1)[1].replace("//", "", 1) if folder.startswith("file:") else folder)


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_files(df: DataFrame, file: str, folder: str, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """Encodes every whole text (null: empty), appends the end id, writes shards in ascending key order (null keys first, ties by text).

    Returns the manifest: (shard, documents, of these with a null key, ids, bytes of an id). A repeated attempt of a task writes the same
    bytes to files of its own and renames them, so a lost executor leaves whole files or none.
    """
    prepare(df.sparkSession)
    frame = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    frame = frame.repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from plansmith.llm.byte_bpe import encoder

        task = TaskContext.get()
        shard, store_path = task.partitionId(), _store(folder)
        store, path = store_path
        enc = encoder(file)
        wide = 2 if enc.library.get_vocab_size() <= 1 << 16 else 4
        own = f"{path}/.{shard}-{task.taskAttemptId()}"
        docs = nulls = total = 0
        with store.open_output_stream(own + ".ids") as ids_out, store.open_output_stream(own + ".offsets") as offsets_out, store.open_output_stream(own + ".docs") as docs_out:
            offsets_out.write(np.zeros(1, "<i8").tobytes())
            for batch in in_pieces(batches, 1, BYTES):
                ids, counts = enc.encode(batch.column(1).to_pylist())
                ends = np.cumsum(counts + 1)
                flat = np.full(int(ends[-1]), END_ID, f"<u{wide}")
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                ids_out.write(flat.tobytes())
                offsets_out.write((ends + total).astype("<i8").tobytes())
                nulls += batch.column(0).null_count
                docs_out.write(np.asarray(batch.column(0).fill_null(0)).astype("<i8").tobytes())
                docs, total = docs + batch.num_rows, total + len(flat)
        for kind in ("ids", "offsets", "docs"):
            store.move(f"{own}.{kind}", f"{path}/{shard}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, docs, nulls, total, wide)], ["shard", "docs", "nulls", "ids", "wide"])

    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    done = frame.mapInArrow(run, "shard bigint, docs bigint, nulls bigint, ids bigint, wide bigint")
    return sorted(tuple(r) for r in done.collect())  # a row a shard


def read_files(spark: SparkSession, folder: str, manifest: list[tuple], key: str = "doc_id") -> DataFrame:
    """A row a document, read from the files: key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    ids = np.array([m[3] for m in manifest], np.int64)
    bases = np.cumsum(ids) - ids
    rows = [(*map(int, m), int(b)) for m, b in zip(manifest, bases, strict=True) if m[1]]
    schema = "shard bigint, docs bigint, nulls bigint, ids bigint, wide bigint, base bigint"
    shards = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def run(batches):
        import pyarrow as pa

        store, path = _store(folder)
        for batch in batches:
            for m in batch.to_pylist():
                flat = _mapped(store, f"{path}/{m['shard']}.ids", f"<u{m['wide']}")
                offsets = np.asarray(_mapped(store, f"{path}/{m['shard']}.offsets", "<i8"))
                names = np.asarray(_mapped(store, f"{path}/{m['shard']}.docs", "<i8"))
                for a in range(0, m["docs"], 4096):
                    b = min(a + 4096, m["docs"])
                    crc = [zlib.crc32(flat[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                    keys = pa.array(names[a:b], pa.int64(), mask=np.arange(a, b) < m["nulls"])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(offsets[a:b] + m["base"]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids into the shared folder and reads them back."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_files(spark, folder, manifest)
