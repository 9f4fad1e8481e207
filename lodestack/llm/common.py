"""Shared helpers: word hashing, Arrow plumbing, size-checked joins, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null ids sort after all others and count as one document.
NO_ID = (1 << 63) - 1
#: A side of a join is broadcast only if it is measured to be at most this large.
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch; one longer row is a batch of its own.
BATCH_BYTES = "8388608b"
#: With it, a query's shuffle files go at its end, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Records that a task gathers before it hands them on.
FLUSH_RECORDS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (null: NO_ID) and the text, under names that no other column clashes with."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"))


def public_id(name: str = "_id"):
    """The id as it came in."""
    return F.when(F.col(name) == NO_ID, F.lit(None).cast("long")).otherwise(F.col(name))


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only a local session may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestack-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, read again, and the path of the table."""
    path = f"{_shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of stored(), once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder. The shuffle files behind it go once the rows are stored."""
    _shared(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREED)
    conf.set(FREED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query takes the setting when it is made, so df keeps its own
    finally:
        conf.set(FREED, before)


def attach(left: DataFrame, side: DataFrame, key: str, how: str = "left", size=0) -> DataFrame:
    """Join on a key; the side is broadcast if its measured size (64 bytes a row, and size) allows, else both are shuffled."""
    cost = F.lit(64) + (F.col(size) if isinstance(size, str) else F.lit(size) if isinstance(size, int) else size)
    small = (side.agg(F.sum(cost.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    return left.join(F.broadcast(side) if small else side, key, how)


def arrow_map(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of a few MB, so that a worker's memory is bounded however long the texts are. A worker gives back what it no longer needs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Return freed memory to the system: workers live on between tasks, beside each other and the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def texts(batch: pa.RecordBatch, name: str = "_text") -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class WordHash(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: ASCII white space, and for each number of bytes the mask of a little-endian word that keeps so many.
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 64


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts (words are split at ASCII white space), and where each text's begin.

    The words of text k are hashes[edges[k] : edges[k + 1]]. Words are read eight bytes at a time, all texts together.
    """
    joined = b"\n".join((b"", *raw, b"")) + bytes(8)
    data = np.frombuffer(joined, np.uint8, len(joined) - 8)
    white = _WHITE[data]
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, length = turns[::2], turns[1::2] - turns[::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    h = fmix((eight[starts] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(more):
        h[more] = fmix(h[more] * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[starts[more] + k] & _KEEP[np.minimum(length[more] - k, 8)]))
        k += 8
        more = more[length[more] > k]
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : starts[i] + length[i]])
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)
    return h, np.concatenate(([0], np.searchsorted(starts, ends)))


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(w: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of k words, modulo 2**64, finalised."""
    if len(w) < k:
        return np.empty(0, np.uint64)
    acc = w[: len(w) - k + 1].copy()
    b = np.uint64(base)
    for j in range(1, k):
        acc *= b
        acc += w[j : len(w) - k + 1 + j]
    return fmix(acc)


def scattered(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each bucket, as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate(([0], edges)) if len(bucket) else edges
    for lo, hi in zip(starts, np.append(edges, len(bucket)), strict=True):
        yield int(bucket[lo]), records[lo:hi].tobytes()


def buckets(spark: SparkSession) -> int:
    """Buckets of a shuffle of packed records: several for each partition of the session."""
    return max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
