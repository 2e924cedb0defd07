"""Shared pieces of the corpus operators: written intermediate tables, word hashing, Arrow batches."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
#: Words whose codes a task remembers (about 10 MB), and bytes of text that it holds as Python objects at a time.
WORD_CACHE, HELD_BYTES = 50_000, 1 << 20
#: Keys with more than this share of all rows, so at most as many keys as its inverse, are joined by a broadcast.
HEAVY = 1 / 5000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one set gets it in its warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return base.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Lineage is cut by a table that outlives any executor, so the shuffle files that led to it are dropped when it is
    written; the folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowloom-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """At the end of a loop of many small jobs: let the driver drop their plans, so that its heap shrinks again."""
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Between steps that allocate much: let the executors collect their garbage, so that their heaps shrink again.

    G1 leaves dead objects in the old generation until they fill 45 % of the heap, and meanwhile takes new memory for the
    young one; beside a heap of its full size little is left for Python workers. Spark deals one short task to each core.
    Tasks that meet in an executor share a collection; an executor that gets none only keeps its garbage.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def discard(df: DataFrame) -> None:
    """Remove the table of a stash() that nothing reads any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until none of ``columns`` is called so (case aside)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def slices(batches: Iterable[pa.RecordBatch], most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of about ``most`` bytes of texts (one row at least), so that what a task turns into
    Python objects does not grow with an Arrow batch."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers are reused and would keep their largest task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keys``, whose column c tells how many rows a key has. Keys with more than HEAVY of the
    ``total`` rows are so few that they are broadcast; no task of the shuffle of the others meets more than that share."""
    most = max(1000, int(total * HEAVY))
    heavy = F.broadcast(keys.where(F.col("c") > most))
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(keys.where(F.col("c") <= most), on))


def fmix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer over a vector."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


class WordCodes(dict):
    """Word (bytes) -> 64-bit code, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = code
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit code for each run of k consecutive words, in order."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n] + np.uint64(k)
    for i in range(1, k):
        h = h * _MUL + codes[i : i + n]
    return fmix(h)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes; no decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one slice of a batch."""

    def each(batches):
        for b in slices(batches):
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(each, schema)
