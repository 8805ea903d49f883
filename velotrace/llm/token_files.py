"""Token-id output: flat unsigned integer files with 64-bit document offsets, memory-mapped by readers.

A folder holds, for each partition p of the ascending id order, `ids-p.bin` (all ids, unsigned 16 or 32 bits, little
endian), `offsets-p.bin` (int64, one more than documents, counted from the file's start) and `keys-p.arrow` (the
document ids, of whatever type, nulls first), and one `manifest.bin`: int64 rows (documents, tokens, documents before,
tokens before), the last two being prefix sums over the partitions.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tokens import byte_bpe, crc32_ids, encoder

END = 0
#: Documents that a reader takes up at once.
AT_ONCE = 10_000


def id_type(tokenizer: str, end_id: int = END) -> str:
    """The narrowest unsigned type that holds all ids."""
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str, uri: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, partitions: int | None = None) -> np.ndarray:
    """Encode whole texts and write them to `uri` in ascending id order (equal ids: by a hash of the text); returns the manifest.

    One range exchange brings documents in order; each task streams its texts to the files, which take their names
    from the partition, so that a repeated attempt replaces them by the same bytes. Only one row of counts per
    partition comes to the driver. Ids are of any type that Spark can order. Null text counts as empty; a very long
    text is encoded whole; null ids come first; repeated rows are written each, rows equal in id and text in any
    order; an empty table gives empty files; other columns of `docs` are not looked at.
    """
    C.bound_batches(docs.sparkSession)
    n = partitions or C.parallelism(docs)
    dtype = id_type(tokenizer, end_id)

    def run(batches):
        enc, p = encoder(tokenizer, dtype), TaskContext.get().partitionId()
        fs, folder = C.open_fs(uri)
        tmp, keys, lengths, end = f"{folder}/{uuid.uuid4().hex}.tmp", [], [np.zeros(1, np.int64)], np.array([end_id], dtype).tobytes()
        with fs.open_output_stream(tmp) as out:
            for batch in C.slices(batches):
                ids = enc.ids([t or "" for t in C.column(batch, "text").to_pylist()])
                out.write(b"".join(x for i in ids for x in (i.tobytes(), end)))
                lengths.append(np.fromiter((len(i) + 1 for i in ids), np.int64, len(ids)))
                keys.append(batch.select(["id"]))
        offsets = np.cumsum(np.concatenate(lengths))
        fs.move(tmp, f"{folder}/ids-{p:06d}.bin")
        C.put_bytes(f"{uri}/offsets-{p:06d}.bin", offsets.astype("<i8").tobytes())
        if keys:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, keys[0].schema) as file:
                for batch in keys:
                    file.write_batch(batch)
            C.put_bytes(f"{uri}/keys-{p:06d}.arrow", sink.getvalue())
        yield pa.RecordBatch.from_pydict({"p": [p], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]})

    ordered = docs.select(C.col(docs, id_col).alias("id"), C.col(docs, text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    counts = {r.p: (r.docs, r.tokens) for r in ordered.mapInArrow(C.released(run), "p long, docs long, tokens long").collect()}
    rows = np.array([counts.get(p, (0, 0)) for p in range(max(counts, default=-1) + 1)], np.int64).reshape(-1, 2)
    manifest = np.hstack([rows, np.cumsum(rows, 0) - rows])
    C.put_bytes(f"{uri}/manifest.bin", manifest.astype("<i8").tobytes())
    return manifest


def read_tokens(spark: SparkSession, uri: str, parts: int, dtype: str, id_kind: T.DataType) -> DataFrame:
    """One row per document from the files: doc_id (of type id_kind), start (ids of all documents before it), n_tokens, ids_crc32."""
    kinds = T.StructType([T.StructField("doc_id", id_kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        manifest = np.frombuffer(C.get_bytes(f"{uri}/manifest.bin"), "<i8").reshape(-1, 4)
        for p in (p for b in batches for p in b.column(0).to_pylist()):
            docs, _, _, base = manifest[p].tolist()
            if not docs:
                continue
            ids, offsets = C.Flat(f"{uri}/ids-{p:06d}.bin", dtype), C.Flat(f"{uri}/offsets-{p:06d}.bin", "<i8")
            fs, path = C.open_fs(f"{uri}/keys-{p:06d}.arrow")
            with fs.open_input_file(path) as f:
                keys = pa.ipc.open_file(f).read_all()["id"].combine_chunks()
            for lo in range(0, docs, AT_ONCE):
                at = np.array(offsets.read(lo, min(lo + AT_ONCE, docs) + 1))
                own = ids.read(int(at[0]), int(at[-1]))
                crc = [crc32_ids(own[a:b]) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                yield pa.RecordBatch.from_arrays([keys[lo : lo + len(crc)], pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], kinds.names)

    if not parts:
        return spark.createDataFrame([], kinds)
    return spark.range(0, parts, 1, parts).mapInArrow(C.released(run), kinds)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, uri = spark.read.parquet(f"{sf_dir}/documents.parquet"), C.shared_dir(spark, "tokens")
    manifest = write_tokens(docs, byte_bpe(), uri)
    return read_tokens(spark, uri, len(manifest), id_type(byte_bpe()), docs.schema["doc_id"].dataType)
