"""Shared helpers: session folders, materialised cuts, table access, vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text makes a step of its own.
CHUNK_BYTES = 1 << 20
#: Rows that travel to Python at a time: whole texts are large, and both sides hold a batch.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What was made inside temporary(): folders, and DataFrames that executors hold.
_SCOPES: list[list] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are written or held inside go at its end; results have to be stored before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for made in _SCOPES.pop():
            free_of(spark, made) if isinstance(made, str) else made.unpersist()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return stored(df, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors for several readers; what a lost executor held is computed anew, with equal rows."""
    if _SCOPES:
        _SCOPES[-1].append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that others can't clash."""
    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def crc_mod(id_col, m: int):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))


# ---------------------------------------------------------------- Arrow text batches


class Texts:
    """Some rows of a batch: ids, and the UTF-8 bytes of all texts in one array with row offsets."""

    __slots__ = ("ids", "data", "offsets", "null")

    def __init__(self, ids, data, offsets, null):
        self.ids, self.data, self.offsets, self.null = ids, data, offsets, null

    def __len__(self):
        return len(self.ids)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The batch's rows in order, in runs of about ``limit`` bytes; a null text has no bytes."""
    col = batch.column(batch.schema.get_field_index("text"))
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    null = np.asarray(col.is_null())
    ids = ids.to_pylist() if ids.null_count else ids.to_numpy(zero_copy_only=False)
    col = col.cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(col))
        lo, hi = offsets[at], offsets[end]
        yield Texts(ids[at:end], data[lo:hi], offsets[at : end + 1] - lo, null[at:end])
        at = end


# ---------------------------------------------------------------- vectorised hashing

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x = x * _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none across a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(firsts[-1]) - np.repeat(firsts[:-1], lengths)
    value = BYTE[data[at + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(value, firsts[:-1]) + lengths.astype(np.uint64))


def words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all rows, and the row offsets into them."""
    starts, ends = runs(~WHITE[t.data], t.offsets)
    return run_hashes(LOWER[t.data], starts, ends), np.searchsorted(starts, t.offsets)


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted, of one row's word hashes; fewer words make one shingle."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total = mix(total + h[i : n - k + 1 + i])
    return np.unique(total)


def free_of(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared place through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_name(path: str) -> str:
    return path[5:] if path.startswith("file:") and not path.startswith("file://") else path


def store(path: str):
    """(file system, path in it) for reading and writing binary files in the shared folder."""
    import pyarrow.fs as fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(local_name(path))
