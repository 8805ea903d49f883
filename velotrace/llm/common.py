"""Shared helpers: the cluster's shared folder, materialised intermediates, bounded Arrow batches, words as byte arrays."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession

#: Text bytes that a Python worker takes up at once.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, and of a source's files for each task.
BATCH_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: bytes.split() parts at exactly these: space and U+0009 to U+000D.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_own: list[str] = []
#: Folders of shared_dir that are there.
_made: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share. Where that is unset a local master gets a folder of our own, and a cluster an error, since its executors could not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="velotrace-"))
        base = _own[0]
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    uri = f"{base.rstrip('/')}/velotrace/{name}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    _made.add(uri)
    atexit.register(remove, uri)
    return uri


def remove(uri: str) -> None:
    """Delete a folder of shared_dir; nothing happens if it has gone."""
    _made.discard(uri)
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


@contextmanager
def scratch():
    """Deletes at its end the folders of shared_dir made inside; for work whose result has been written elsewhere by then."""
    before = set(_made)
    try:
        yield
    finally:
        for uri in _made - before:
            remove(uri)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under another name first: a second attempt of a task, or a speculative one, replaces it by the same content."""
    fs, path = open_fs(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)


def get_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


class Flat:
    """A flat file as an array that is sliced: memory-mapped where it is a local path, else read by ranges."""

    def __init__(self, uri: str, dtype: str | np.dtype):
        self.fs, self.path = open_fs(uri)
        self.dtype = np.dtype(dtype)
        local = self.fs.type_name == "local" and self.fs.get_file_info(self.path).size
        self.mapped = np.memmap(self.path, self.dtype, "r") if local else None

    def read(self, lo: int, hi: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[lo:hi]
        if lo >= hi:
            return np.zeros(0, self.dtype)
        with self.fs.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def materialize(df: DataFrame, name: str, uri: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder (at `uri` if given); lost executors lose nothing of it."""
    spark = df.sparkSession
    uri = uri or shared_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def parallelism(docs: DataFrame) -> int:
    """Tasks for what comes from docs: spark.sql.shuffle.partitions, or one for each TASK_BYTES of the files read if that is more."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    # A source of unknown size says that it has the greatest.
    known = sum(s for s in sizes if s < 1 << 62)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // TASK_BYTES))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches that Spark hands to Python hold 8 MB at most, so that long texts don't fill a worker. It is the session's setting, since plans are lazy, and a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get(name).strip().lower())
    if not have or int(have[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[have[2]] > BATCH_BYTES or not int(have[1]):
        spark.conf.set(name, str(BATCH_BYTES))


def released(run):
    """A task's function that gives freed memory back to the system at its end, since Spark keeps its worker for later tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return task


def slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """Arrow batches cut so that each holds about `limit` bytes of text (a longer text stands alone)."""
    for batch in batches:
        n, lo = batch.num_rows, 0
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def col(df: DataFrame, name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; null has none."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_M = 0x9E3779B97F4A7C15
_MINV = pow(_M, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int, kind: str) -> np.ndarray:
    if kind not in _pow or len(_pow[kind]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _M if kind == "up" else _MINV, np.uint64)
        p[0] = 1
        _pow[kind] = np.multiply.accumulate(p)
    return _pow[kind][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a uint8 array."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, of which span_hashes takes differences."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(len(data), "up"), dtype=np.uint64)))


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    return mix64((sums[ends] - sums[starts]) * _powers(len(sums), "down")[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hashes(byte_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word hashes, by doubling; empty if there are fewer words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, words, 1
    mul = np.uint64(_M)
    while have < k:
        if k & size:
            if out is None:
                out = power
            else:
                m = len(out) - size if len(power) >= len(out) else len(power) - have
                m = min(len(out), len(power) - have)
                out = mix64(out[:m] * mul + power[have : have + m])
            have += size
        m = len(power) - size
        if have < k:
            power = mix64(power[:m] * mul + power[size : size + m])
            size *= 2
    return out[: len(words) - k + 1]
