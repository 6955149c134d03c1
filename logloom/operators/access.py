"""Rows by line number and by byte offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_at(lines: DataFrame, number: int) -> DataFrame:
    """The line, or no row where there is none. The predicate reaches Parquet, whose statistics skip the rest."""
    return lines.where(F.col("line") == number)


def lines_from(lines: DataFrame, number: int) -> DataFrame:
    """The lines from a number on."""
    return lines.where(F.col("line") >= number)


def line_count(lines: DataFrame, by: str = "src") -> DataFrame:
    return lines.groupBy(by).agg(F.count("*").alias("lines"))


def line_starts(lines: DataFrame, by: str = "src", raw: str = "raw", chunk: int = 1 << 18) -> DataFrame:
    """Adds ``start``: the byte at which a line begins. Sums go over chunks of lines, so that no task has a whole source."""
    parts = lines.withColumn("_chunk", F.floor(F.col("line") / chunk)).withColumn("_size", F.octet_length(raw) + 1)
    inner = Window.partitionBy(by, "_chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(by, "_chunk").agg(F.sum("_size").alias("_n")).select(by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return parts.join(totals, [by, "_chunk"]).withColumn("start", (F.col("_base") + F.coalesce(F.sum("_size").over(inner), F.lit(0))).cast("bigint")).drop("_chunk", "_size", "_base")


def offset_to_line(lines: DataFrame, offsets: DataFrame, by: str = "src", raw: str = "raw") -> DataFrame:
    """(src, offset, line) for ``offsets`` (src, offset): the line that has the byte; a line feed belongs to the line that it ends.

    Line starts and offsets are merged in order within buckets of 1 MiB; a line that reaches into later buckets is listed in each.
    """
    bucket = 1 << 20
    started = line_starts(lines, by, raw).select(by, "line", "start", (F.col("start") + F.octet_length(raw)).alias("last"))
    reach = started.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("last") / bucket))))
    asked = offsets.withColumn("_bucket", F.floor(F.col("offset") / bucket))
    inside = F.col("offset").between(F.col("start"), F.col("last"))
    return asked.join(reach, [by, "_bucket"]).where(inside).select(by, "offset", "line")
