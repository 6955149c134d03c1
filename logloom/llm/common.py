"""Helpers that the training-data operators share: tables, shared folders, words and hashes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_folder as work_dir
from ..plans.storage import shared_folder

#: Words of the result contracts: maximal runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Spark SQL (Java) patterns.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that go to Python together. The session's default of 10,000 may be hundreds of MB in each worker and off the heap.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one module's operators. Workers serve one operator after the other, so
    that what another one kept goes first."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def give_back() -> None:
    """Returns freed memory to the system; workers outlive their tasks. What can't be told to do so is left alone."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep_memory() -> None:
    """Freed memory stays with this process until ``give_back``: large arrays that come and go needn't be cleared by the system
    each time. What can't be told to do so is left alone."""
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for option, value in ((-1, 1 << 30), (-2, 1 << 26), (-3, 1 << 30)):  # M_TRIM_THRESHOLD, M_TOP_PAD, M_MMAP_THRESHOLD
            libc.mallopt(option, value)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over small batches, by workers that keep nothing of other modules' operators, nor free memory after a task."""
    small_batches(df.sparkSession)
    owner, names = run.__module__, df.columns

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache(owner)
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            give_back()

    # Spark takes a dot in a name for a path here
    return (df.toDF(*(f"c{k}" for k in range(len(names)))) if any("." in n for n in names) else df).mapInArrow(alone, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly that name, which may have dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: list[str], base: str) -> str:
    """``base``, with underscores before it until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: the table is written to the shared folder and read back with its schema."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that one task takes well.
ROWS_TOGETHER = 250_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of that many rows at most, in as few partitions as they need; never in more than it has."""
    return df.coalesce(max(1, -(-rows // ROWS_TOGETHER)))


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote below the shared one."""
    assert path.startswith(shared_folder(spark)), path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply); spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter; none if empty."""
    n = len(words)
    if n == 0:
        return words
    k_eff = min(k, n)
    out = np.zeros(n - k_eff + 1, np.uint64)
    for i in range(k_eff):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k_eff + 1 + i] + np.uint64(i + 1))
    return out


def array_slices(column: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """The column's texts in order, in arrays of ``most_bytes`` together, or of one longer text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    at, done = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
        yield column.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def text_slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[list[str | None]]:
    """The same as lists."""
    for part in array_slices(column, most_bytes):
        yield part.to_pylist()


def lower_ascii(text: str) -> str:
    """Lower-cases A to Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}
