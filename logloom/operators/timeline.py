"""Timelines of sources, and their merge into one order.

A timeline is (src, line, ts) with gaps filled. The merge takes, again and again, the source whose next line has the smallest (ts, src). That is
the order of (largest ts so far in the source, src, line): lines that hold back others of their source leave in one go. All
running values go over chunks of bounded size, so that a source may have any number of lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

CHUNK = 1 << 16


def _chunked(df: DataFrame, place: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(place) / chunk))


def _carried(df: DataFrame, by: list[str], of_chunk: Column, before: Callable[[Column], Column], forward: bool = True) -> DataFrame:
    """Adds ``_carry``: ``before`` over the values of all chunks before (after) a row's own."""
    order = F.col("_chunk") if forward else F.desc("_chunk")
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(*by, "_chunk").agg(of_chunk.alias("_of"))
    return df.join(chunks.select(*by, "_chunk", before(F.col("_of")).over(earlier).alias("_carry")), [*by, "_chunk"])


def fill(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(src, line, ts) with null ts filled: by the last one before, at the start by the first one after, or 0 if there is none. ``rows`` is read twice."""
    parts = _chunked(rows.select("src", "line", "ts"), "line", chunk)
    known = F.when(F.col("ts").isNotNull(), F.col("line"))
    every = Window.partitionBy("src").orderBy("_chunk")
    chunks = parts.groupBy("src", "_chunk").agg(F.max_by("ts", known).alias("_last"), F.min_by("ts", known).alias("_head"))
    carry = F.last("_last", True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_head", True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.join(chunks.select("src", "_chunk", carry.alias("_carry"), first.alias("_first")), ["src", "_chunk"])
    own = F.last("ts", True).over(Window.partitionBy("src", "_chunk").orderBy("line"))
    return parts.select("src", "line", F.coalesce(own, "_carry", "_first", F.lit(0)).cast("bigint").alias("ts"))


def extract_timeline(lines: DataFrame, ts: Column, chunk: int = CHUNK) -> DataFrame:
    """The timeline of ``lines`` by any column that is the line's time or null. Times are told once, and stored."""
    return fill(stored(lines.select("src", "line", ts.alias("ts"))), chunk)


def extract_append(old: DataFrame, lines: DataFrame, ts: Column, chunk: int = CHUNK) -> DataFrame:
    """The timeline of new lines after an ``old`` one: filled from its last time, or 0, never back.

    Raises ValueError if the new lines don't begin where the old ones end.
    """
    ends = old.groupBy("src").agg((F.max("line") + 1).alias("_end"), F.max_by("ts", "line").alias("_last"))
    begins = lines.groupBy("src").agg(F.min("line").alias("_begin"))
    if not begins.join(ends, "src", "left").where(F.col("_begin") != F.coalesce("_end", F.lit(0))).isEmpty():
        raise ValueError("new lines don't follow the old ones")
    parts = _chunked(stored(lines.select("src", "line", ts.alias("ts"))), "line", chunk)
    parts = _carried(parts, ["src"], F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))), lambda c: F.last(c, True))
    own = F.last("ts", True).over(Window.partitionBy("src", "_chunk").orderBy("line"))
    return parts.join(ends, "src", "left").select("src", "line", F.coalesce(own, "_carry", "_last", F.lit(0)).cast("bigint").alias("ts"))


def positioned(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``pos``, a row's place in the order: ranges are sorted apart, and each begins at the sum of the sizes of those before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    parts = dealt.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each range
    base = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = dealt.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(base), "_part")
    return out.withColumn("pos", (F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_id", "_part", "_base")


def build_index(timeline: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(pos, ts, src, line): the merge of all sources. File order is never broken; at equal times the lower source goes first."""
    parts = _carried(_chunked(timeline.select("src", "line", "ts"), "line", chunk), ["src"], F.max("ts"), F.max)
    own = F.max("ts").over(Window.partitionBy("src", "_chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    keyed = parts.select("ts", "src", "line", F.greatest(own, "_carry").alias("_key"))
    return positioned(keyed, "_key", "src", "line").select("pos", "ts", "src", "line")


def build_index_masked(timeline: DataFrame, visible: Iterable[bool], chunk: int = CHUNK) -> DataFrame:
    """The merge without hidden sources; sources beyond the mask are visible, and all keep their numbers."""
    hidden = [k for k, v in enumerate(visible) if not v]
    return build_index(timeline.where(~F.col("src").isin(hidden)) if hidden else timeline, chunk)


def insert_rows(index: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The index with new ``rows`` (src, line, ts), each after the last row whose (ts, src, line) isn't larger.

    A row's key is the smallest one from it on; new rows have their own. Existing rows go first at equal keys.
    """
    key = F.struct("ts", "src", "line")
    parts = _chunked(index.select("pos", "ts", "src", "line"), "pos", chunk).withColumn("_all", F.lit(0))
    parts = _carried(parts, ["_all"], F.min(key), F.min, forward=False)
    # from the last row backward, as a frame that grows at its end is added to, and one that shrinks is made anew for each row
    own = F.min(key).over(Window.partitionBy("_chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    old = parts.select("ts", "src", "line", F.least(own, F.coalesce("_carry", own)).alias("_key"), F.lit(0).alias("_new"), F.col("pos").alias("_pos"))
    new = rows.select(F.col("ts").cast("bigint"), F.col("src").cast(index.schema["src"].dataType), F.col("line").cast("bigint"))
    new = new.select("ts", "src", "line", key.alias("_key"), F.lit(1).alias("_new"), F.lit(0).cast("bigint").alias("_pos"))
    flat = old.unionByName(new).select("ts", "src", "line", F.col("_key.ts").alias("_ts"), F.col("_key.src").alias("_src"), F.col("_key.line").alias("_line"), "_new", "_pos")
    return positioned(flat, "_ts", "_src", "_line", "_new", "_pos").select("pos", "ts", "src", "line")


def remove_row(index: DataFrame, src: int, line: int) -> DataFrame:
    """The index without the row, wherever it is; unchanged if there is none."""
    gone = (F.col("src") == src) & (F.col("line") == line)
    at = index.agg(F.max(F.when(gone, F.col("pos"))).alias("_at"))
    rows = index.where(~gone).crossJoin(F.broadcast(at))
    return rows.select((F.col("pos") - F.when(F.col("pos") > F.col("_at"), 1).otherwise(0)).cast("bigint").alias("pos"), "ts", "src", "line")


def holds_row(index: DataFrame, src: int, line: int) -> DataFrame:
    """(held): whether the index has the row, and so whether ``remove_row`` removes one."""
    return index.agg(F.coalesce(F.bool_or((F.col("src") == src) & (F.col("line") == line)), F.lit(False)).alias("held"))


def index_size(index: DataFrame) -> DataFrame:
    """(rows, index_bytes, ts_bytes): 16 bytes a merged row and 8 a time, as a compact store has them."""
    return index.agg(F.count("*").alias("rows"), (16 * F.count("*")).alias("index_bytes"), (8 * F.count("*")).alias("ts_bytes"))


def rows_between(index: DataFrame, first: int, end: int) -> DataFrame:
    """The rows at places from ``first`` up to ``end``."""
    return index.where((F.col("pos") >= first) & (F.col("pos") < end))
