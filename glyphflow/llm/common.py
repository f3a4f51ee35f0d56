"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores put before it until no column bears it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, UPPER, UPPER.lower())


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, mod n; null for null."""
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where driver and workers are one process may it be unset: a temporary one is then
    set. RuntimeError on a cluster without one, as its machines share no local folder."""
    sc = spark.sparkContext
    if not (found := sc.getConf().get("spark.checkpoint.dir", None)) and not (found := sc.getCheckpointDir()):
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="glyphflow-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Has Spark remove a query's shuffles as soon as it ends, which a written table makes safe.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, goes when discarded or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._drop = functools.partial(dropped, spark, path)
    atexit.register(out._drop)
    return out


def dropped(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for t in tables:
        t._drop()
        atexit.unregister(t._drop)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes in the column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, most_bytes + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, until - at)
        at = until


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back at a task's end: workers live on and would each keep their peak."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, over an array of uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few enough for a worker's memory."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
