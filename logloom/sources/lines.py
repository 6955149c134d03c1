"""Text files as tables (path, line, value, raw, fed).

``line`` counts from 0 in each file; a final line feed opens no line; ``value`` has one carriage return less at its end, ``raw`` doesn't; ``fed`` tells whether a
line feed follows, as it does but for the last line of some files. UTF-8, UTF-16 (with and without mark), GBK and Latin-1 are told by a sample of each file's head, of which
no more than that is read. Files may be of any size: all are read in stretches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import sent_if_small

UTF8, UTF16LE, UTF16BE, GBK, LATIN1 = "utf-8", "utf-16le", "utf-16be", "gbk", "latin-1"
HEAD_BYTES = 64 << 10
MARK = b"\xef\xbb\xbf"
SCHEMA = "path string, line bigint, value string, raw string, fed boolean"
#: Bytes of a stretch, and those read at a time.
STRETCH, READ = 64 << 20, 4 << 20
_MEMBER_BITS = 33


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def without_cr(raw: Column) -> Column:
    """One carriage return less at the end."""
    return F.when(F.endswith(raw, F.lit("\r")), F.substr(raw, F.lit(1), F.char_length(raw) - 1)).otherwise(raw)


def detect_encoding(head: bytes, whole: bool = False) -> str:
    """From a file's first bytes: byte-order marks, zero bytes at alternate places, valid UTF-8, valid GBK, else Latin-1.

    ``whole``: the sample is the whole file; otherwise a character cut off at its end doesn't count.
    """
    if head.startswith(MARK):
        return UTF8
    if head.startswith(b"\xff\xfe"):
        return UTF16LE
    if head.startswith(b"\xfe\xff"):
        return UTF16BE
    sample = head[: len(head) & ~1]
    if len(sample) >= 4:
        even, odd = sample[0::2].count(0), sample[1::2].count(0)
        most = len(sample) // 2
        if odd > 0.4 * most and even < 0.05 * most:
            return UTF16LE
        if even > 0.4 * most and odd < 0.05 * most:
            return UTF16BE
    for name in ("utf-8", "gbk"):
        try:
            head.decode(name)
            return UTF8 if name == "utf-8" else GBK
        except UnicodeDecodeError as e:
            if not whole and e.end >= len(head) and len(head) - e.start < 4:
                return UTF8 if name == "utf-8" else GBK
    return LATIN1


def opened(path: str) -> pa.NativeFile:
    """A file for reading by range, by the path that Spark gives it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return pafs.LocalFileSystem().open_input_file("/" + (rest if scheme == "file" else path).lstrip("/"))
    store, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(at)


def _listed(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(path, size, modified) of the files; their content isn't read."""
    names = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(names).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def heads(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(path, size, modified, encoding, mark_only, fed) of each file, from its first bytes and its last one, which tasks read by range. ``fed``: it
    ends with a line feed (of its encoding)."""
    told = "encoding string, mark_only boolean, fed boolean"

    @F.pandas_udf(told)
    def look(paths: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for path, size in zip(paths, sizes, strict=True):
            with opened(path) as f:
                head = f.read_at(min(HEAD_BYTES, size), 0)
                encoding = detect_encoding(head, size <= HEAD_BYTES)
                feed = "\n".encode(encoding)
                rows.append((encoding, head == MARK, size >= len(feed) and f.read_at(len(feed), size - len(feed)) == feed))
        return pd.DataFrame(rows, columns=["encoding", "mark_only", "fed"])

    return _listed(spark, paths).withColumn("told", look("path", "size")).select("path", "size", "modified", "told.*")


def numbered(scan: DataFrame) -> DataFrame:
    """A text scan with ``line``, and ``last`` for the last line. Within a split, lines are counted by the ids that are given as they are read; splits start at the sum of the
    counts of those before them. The text is read twice, and never sorted or moved."""
    rows = scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("id"))
    member = F.shiftright("id", _MEMBER_BITS)
    splits = rows.groupBy("path", "block", member.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("path"))
    base = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), total.alias("total"))
    # a row for each split of each file
    line = F.col("base") + F.col("id") - F.col("first")
    return rows.join(sent_if_small(base), ["path", "block"]).select("path", line.alias("line"), "raw", (line == F.col("total") - 1).alias("last"))


def _lines16(f: pa.NativeFile, size: int, start: int, end: int, little: bool) -> Iterator[list[bytes]]:
    """The lines of a UTF-16 file that begin at bytes ``start`` to ``end``, in lists; without their line feeds."""
    unit = np.dtype("<u2" if little else ">u2")
    size -= size % 2
    # a line begins at 0 or after a line feed; the one that ends at ``start`` - 2 is looked for too
    at, held, begun = max(0, start - 2), [], start == 0
    line_at = 0
    while at < size:
        data = f.read_at(min(READ, size - at), at)
        feeds = np.flatnonzero(np.frombuffer(data, unit) == 10) * 2
        out, done = [], 0
        for k in feeds.tolist():
            if begun:
                out.append(b"".join([*held, data[done:k]]))
                held = []
            begun, done, line_at = True, k + 2, at + k + 2
            if line_at >= end:
                yield out
                return
        if begun:
            held.append(data[done:])
        at += len(data)
        yield out
    if begun and line_at < min(end, size):
        yield [b"".join(held)]


def _utf16(spark: SparkSession, files: list[str], kind: str) -> DataFrame:
    """(path, line, raw, last) of UTF-16 files: stretches are counted first, and then read with the number that each begins with."""
    stretches = _listed(spark, files).select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(STRETCH).cast("long"))).alias("start"))
    stretches = stretches.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path", "start")
    little = kind == UTF16LE

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, start in zip(batch["path"], batch["size"], batch["start"], strict=True):
                with opened(path) as f:
                    rows.append((path, size, start, sum(map(len, _lines16(f, size, start, start + STRETCH, little)))))
            yield pd.DataFrame(rows, columns=["path", "size", "start", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                line, total = row["base"], row["total"]
                with opened(row["path"]) as f:
                    for found in _lines16(f, row["size"], row["start"], row["start"] + STRETCH, little):
                        texts = [x.decode(kind, "replace") for x in found]
                        if line == 0 and texts:
                            texts[0] = texts[0].removeprefix("\ufeff")
                        if total == 1 and texts == [""] and row["size"] == 2:
                            texts = []  # a mark alone
                        numbers = np.arange(line, line + len(texts))
                        line += len(texts)
                        yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(texts), pa.string()), pa.array(numbers), pa.array(texts, pa.string()), pa.array(numbers == total - 1)], names=["path", "line", "raw", "last"])

    own = Window.partitionBy("path")
    before = own.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = stretches.mapInPandas(counted, "path string, size long, start long, n long")
    # a row for each stretch of each file
    begins = sent_if_small(counts.select("path", "size", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(own).alias("total")))
    return begins.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path", "start").mapInArrow(read, "path string, line long, raw string, last boolean")


def split_lines(text: Column) -> Column:
    """A whole text's lines: no line for an empty text, none after a final line feed."""
    parts = F.split(text, "\n")
    return F.when(F.char_length(text) == 0, F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def open_lines(spark: SparkSession, paths: str | Iterable[str], encoding: str | None = None) -> DataFrame:
    """All lines of the files, which are read in splits. The driver lists them: a row for each file."""
    found = heads(spark, paths) if encoding is None else heads(spark, paths).withColumn("encoding", F.lit(encoding))
    files = found.select("path", "encoding", "mark_only", "fed").collect()
    out = empty(spark)
    for kind in sorted({r["encoding"] for r in files}):
        names = sorted(r["path"] for r in files if r["encoding"] == kind)
        if kind in (UTF16LE, UTF16BE):
            lines = _utf16(spark, names, kind)
        else:
            lines = numbered(spark.read.option("lineSep", "\n").text(names))
            if kind != UTF8:
                lines = lines.withColumn("raw", decoded(F.col("raw"), kind))
        unfed = sorted(r["path"] for r in files if r["encoding"] == kind and not r["fed"])
        fed = ~F.col("last")
        if len(unfed) < len(names):
            ends = F.regexp_replace("path", "^file:/+", "file:/").isin([_plain(n) for n in unfed]) if len(unfed) <= 1000 else None
            if ends is None:
                flags = F.broadcast(spark.createDataFrame([(_plain(n),) for n in unfed], "unfed string")) if len(unfed) <= 200_000 else spark.createDataFrame([(_plain(n),) for n in unfed], "unfed string")
                lines = lines.join(flags, F.regexp_replace("path", "^file:/+", "file:/") == F.col("unfed"), "left")
                ends = F.col("unfed").isNotNull()
            fed = ~(F.col("last") & ends)
        out = out.unionByName(lines.select("path", "line", without_cr(F.col("raw")).alias("value"), "raw", fed.alias("fed")))
    # a mark alone is an empty line, which Spark's scan leaves out
    if marks := [(r["path"], 0, "", "", False) for r in files if r["mark_only"] and r["encoding"] == UTF8]:
        out = out.unionByName(spark.createDataFrame(marks, SCHEMA))
    return out


def _plain(path: str) -> str:
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def decoded(raw: Column, kind: str) -> Column:
    """Bytes that a scan kept as they are, as text of the encoding."""
    if kind == LATIN1:
        return F.decode(raw.cast("binary"), "ISO-8859-1")

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else bytes(d).decode(kind, "replace") for d in data], dtype=object)

    return text(raw.cast("binary"))


def stats(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(path, size, modified, encoding, stored, lines) of the files in ``found`` (see heads). ``stored`` is UTF-8 for UTF-16 files."""
    counts = lines.groupBy("path").agg(F.count("*").alias("lines"))
    stored = F.when(F.col("encoding").isin(UTF16LE, UTF16BE), UTF8).otherwise(F.col("encoding"))
    return found.join(counts, "path", "left").select("path", "size", "modified", "encoding", stored.alias("stored"), F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"))


def export_bytes(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """(path, start, content): the files as they are, in stretches; none for an empty file."""
    stretches = _listed(spark, path).where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(stretch).cast("long"))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"], strict=True):
                with opened(path) as f:
                    yield pd.DataFrame({"path": [path], "start": [start], "content": [f.read_at(min(stretch, size - start), start)]})

    return stretches.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path", "start").mapInPandas(read, "path string, start long, content binary")


def mib_per_second(size: int, seconds: float) -> float:
    return float("inf") if seconds <= 0 else size / (1 << 20) / seconds
