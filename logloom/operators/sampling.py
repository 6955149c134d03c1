"""Detection from the first lines of each source: JSON Lines or not, its columns, where its timestamps are.

Samples have a number of lines and a budget of bytes that counts from the sixth line on. They are cut by line number first, so that
the rest of a source isn't read into any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonfields
from ..functions.timestamps import field_time, probe_format
from ..functions.tokens import once
from ..plans.storage import stored

#: Limits of the samples, shares, widths, and the names of time fields in their order.
DETECT_LINES, DETECT_BYTES, DETECT_SHARE = 64, 2 << 20, 0.9
SCHEMA_LINES, SCHEMA_BYTES, MOST_COLUMNS = 512, 4 << 20, 16
NARROWEST, WIDEST = 4, 32
ROUTE_LINES, ROUTE_BYTES, ROUTE_SHARE = 512, 4 << 20, 0.5
LEAST_LINES, LEAST_SAMPLED = 6, 3
#: Lines of each source that a route is looked for in at first.
FIRST_LINES = 8 * ROUTE_LINES
TIME_FIELDS = ("ts", "timestamp", "time", "@timestamp")


def _before(by: str) -> Window:
    return Window.partitionBy(by).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)


def _size() -> Column:
    return F.octet_length("value")


def head(lines: DataFrame, most_lines: int, most_bytes: int, by: str = "src") -> DataFrame:
    """The first lines, until the budget is used up by those before."""
    rows = lines.where(F.col("line") < most_lines)
    spent = F.coalesce(F.sum(_size()).over(_before(by)), F.lit(0))
    return rows.withColumn("_spent", spent).where((F.col("line") < LEAST_LINES) | (F.col("_spent") < most_bytes)).drop("_spent")


def detect_jsonl(lines: DataFrame, by: str = "src") -> DataFrame:
    """(src, is_jsonl): three lines or more that aren't empty, nine tenths of them JSON objects."""
    sample = head(lines, #: Fixed values: limits of the samples, shares, widths, and the names of time fields in their order.
DETECT_LINES, DETECT_BYTES, by).where(_size() > 0).select(by, jsonfields.is_object(F.col("value")).alias("object"))
    told = sample.groupBy(by).agg(F.count("*").alias("n"), F.count_if("object").alias("objects"))
    told = told.select(by, ((F.col("n") >= LEAST_SAMPLED) & (F.col("objects") >= DETECT_SHARE * F.col("n"))).alias("is_jsonl"))
    return lines.where(F.col("line") == 0).select(by).distinct().join(told, by, "left").select(by, F.coalesce("is_jsonl", F.lit(False)).alias("is_jsonl"))


def discover_schema(lines: DataFrame, by: str = "src") -> DataFrame:
    """(src, ord, name, width): outermost keys in the order in which they are first seen, 16 at most, and their display width."""
    sample = head(lines, SCHEMA_LINES, SCHEMA_BYTES, by)
    seen = sample.select(by, "line", F.posexplode(jsonfields.keys(F.col("value"))).alias("pos", "key"))
    keys = seen.groupBy(by, F.col("key.name").alias("name")).agg(F.min(F.struct("line", "pos")).alias("first"), F.max("key.width").alias("width"))
    ranked = keys.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).where(F.col("ord") < MOST_COLUMNS)
    return ranked.select(by, F.col("ord").cast("int").alias("ord"), "name", F.least(F.greatest("width", F.lit(NARROWEST)), F.lit(WIDEST)).cast("int").alias("width"))


def _sampled(lines: DataFrame, counts: Column, by: str, first: DataFrame | None = None) -> DataFrame:
    """Lines up to ROUTE_LINES that count. Where a source's first lines (``first`` has them) don't have as many, more are read, sixteen times as many each time."""
    most = FIRST_LINES
    while True:
        rows = lines.where(F.col("line") < most) if first is None or most > FIRST_LINES else first
        short = rows.groupBy(by).agg(F.count_if(counts).alias("n"), F.max("line").alias("last")).where((F.col("n") < ROUTE_LINES) & (F.col("last") == most - 1))
        if short.isEmpty():
            break
        most *= 16
    # chunks that begin within the limits, from what those before them have; only these are looked at line by line
    parts = rows.withColumn("_chunk", F.floor(F.col("line") / FIRST_LINES)).withColumn("_counts", counts.cast("int"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(by, "_chunk").agg(F.sum("_counts").alias("_n_own"), F.sum(_size()).alias("_size_own"))
    totals = totals.select(by, "_chunk", F.coalesce(F.sum("_n_own").over(earlier), F.lit(0)).alias("_n_base"), F.coalesce(F.sum("_size_own").over(earlier), F.lit(0)).alias("_size_base"))
    within = lambda n, size: (F.col(n) < ROUTE_LINES) & ((F.col(n) < LEAST_LINES) | (F.col(size) < ROUTE_BYTES))
    inner = Window.partitionBy(by, "_chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(totals.where(within("_n_base", "_size_base")), [by, "_chunk"])
    rows = rows.withColumn("_n", F.col("_n_base") + F.coalesce(F.sum("_counts").over(inner), F.lit(0))).withColumn("_spent", F.col("_size_base") + F.coalesce(F.sum(_size()).over(inner), F.lit(0)))
    return rows.where(within("_n", "_spent")).where(counts).drop("_n", "_spent", "_n_base", "_size_base", "_counts", "_chunk")


def detect_route(lines: DataFrame, by: str = "src") -> DataFrame:
    """(src, ok, kind, arg, failure) of each source: ``jsonl_field`` with the field's name, ``log_prefix`` with the format, or why not:
    ``no_time_field``, ``no_timestamp``, ``inconsistent``."""
    # all sources' first lines are read once
    first = stored(lines.where(F.col("line") < FIRST_LINES))
    kinds = stored(detect_jsonl(first, by))
    told, told_first = lines.join(kinds, by), stored(first.join(kinds, by))
    line = F.col("value")

    fields = _sampled(told.where("is_jsonl"), _size() > 0, by, told_first.where("is_jsonl"))
    # within ``once``, times are told without code of their own being compiled, which takes longer than all samples
    share = [F.count_if(once(jsonfields.scan_field(line, n), lambda f: field_time(f).isNotNull())).alias(f"hit{k}") for k, n in enumerate(TIME_FIELDS)]
    hits = fields.groupBy(by).agg(F.count("*").alias("n"), *share)
    passed = F.lit(None).cast("string")
    for k, n in reversed(list(enumerate(TIME_FIELDS))):
        passed = F.when((F.col("n") >= LEAST_SAMPLED) & (F.col(f"hit{k}") >= ROUTE_SHARE * F.col("n")), n).otherwise(passed)
    json_routes = hits.select(by, passed.alias("arg")).select(by, F.col("arg").isNotNull().alias("ok"), F.when(F.col("arg").isNotNull(), "jsonl_field").alias("kind"), "arg", F.when(F.col("arg").isNull(), "no_time_field").alias("failure"))

    plain = _sampled(told.where("NOT is_jsonl"), (_size() > 0) & ~F.substring(line, 1, 1).isin(" ", "\t"), by, told_first.where("NOT is_jsonl"))
    formats = plain.select(by, once(line, probe_format).alias("format")).groupBy(by).agg(F.count("*").alias("n"), F.count("format").alias("hits"), F.min("format").alias("least"), F.max("format").alias("most"))
    failure = F.when((F.col("hits") == 0) | (F.col("n") < LEAST_SAMPLED) | (F.col("hits") < ROUTE_SHARE * F.col("n")), "no_timestamp").when(F.col("least") != F.col("most"), "inconsistent")
    log_routes = formats.select(by, F.col("least").alias("arg"), failure.alias("failure")).select(by, F.col("failure").isNull().alias("ok"), F.when(F.col("failure").isNull(), "log_prefix").alias("kind"), F.when(F.col("failure").isNull(), F.col("arg")).alias("arg"), "failure")

    found = json_routes.unionByName(log_routes)
    every = kinds.join(found, by, "left")
    why = F.when(F.col("ok").isNull(), F.when(F.col("is_jsonl"), "no_time_field").otherwise("no_timestamp")).otherwise(F.col("failure"))
    return every.select(by, F.coalesce("ok", F.lit(False)).alias("ok"), "kind", "arg", why.alias("failure"))
