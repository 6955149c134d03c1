"""Lines, JSON lines, log lines and timelines made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lines import split_lines, without_cr

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, line, value, raw, fed): the lines of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), split_lines(F.col("text")).alias("lines"), F.endswith("text", F.lit("\n")).alias("ended"))
    docs = docs.select("src", "ended", F.size("lines").alias("n"), F.posexplode("lines").alias("line", "raw"))
    return docs.select("src", F.col("line").cast("bigint").alias("line"), without_cr(F.col("raw")).alias("value"), "raw", (F.col("ended") | (F.col("line") < F.col("n") - 1)).alias("fed"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with ``ms``, the epoch milliseconds of its times, which have no zone."""
    days = F.unix_date(F.col("ts").cast("date")).cast("bigint")
    ms = ((days * 24 + F.hour("ts")) * 60 + F.minute("ts")) * 60_000 + (F.expr("extract(SECOND FROM ts)") * 1000).cast("bigint")
    return table(spark, sf_dir, "events").withColumn("ms", ms)


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src 0, line = event id, value): a JSON object for each event."""
    value = F.concat(
        F.lit('{"ts":'), F.col("ms").cast("string"), F.lit(',"level":"'), F.upper("event_type"), F.lit('","user":{"id":'), F.col("user_id").cast("string"),
        F.lit(',"tags":["a",'), (F.col("event_id") % 7).cast("string"), F.lit(']},"props":'), F.col("props"), F.lit("}"),
    )
    return events(spark, sf_dir).select(F.lit(0).alias("src"), F.col("event_id").alias("line"), value.alias("value"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src 0 to 3, line, value): log lines with ISO, log4j, second and millisecond stamps; every tenth line continues the one before."""
    e = events(spark, sf_dir)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    part = F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.translate(stamp, " ", "T"), F.lit("."), part, F.lit("Z")))
        .when(kind == 1, F.concat(stamp, F.lit(","), part))
        .when(kind == 2, F.floor(F.col("ms") / 1000).cast("string"))
        .otherwise(F.col("ms").cast("string"))
    )
    line = F.floor(F.col("event_id") / 4)
    value = F.when(line % 10 == 9, F.concat(F.lit("  at "), F.col("event_type"))).otherwise(F.concat(text, F.lit(" "), F.upper("event_type")))
    return e.select(kind.cast("int").alias("src"), line.cast("bigint").alias("line"), value.alias("value"), "ms")


def timelines(spark: SparkSession, sf_dir: str, disorder: bool = False) -> DataFrame:
    """(src, line, ts): a source for each event type, in the order of event ids. ``disorder`` shifts some times by up to an hour."""
    e = events(spark, sf_dir)
    types = e.select("event_type").distinct()
    # as many rows as there are event types
    numbers = types.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("src"))
    ts = F.col("ms") + (F.col("event_id") % 7) * 600_000 if disorder else F.col("ms")
    # numbers count on from those of the chunks of ids before, so that no task has all events of a type
    parts = e.withColumn("chunk", F.floor(F.col("event_id") / 65_536))
    before = Window.partitionBy("event_type").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("event_type", "chunk").agg(F.count("*").alias("n")).select("event_type", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("event_type", "chunk").orderBy("event_id")) - 1
    lines = parts.join(base, ["event_type", "chunk"]).withColumn("line", (F.col("base") + inner).cast("bigint"))
    return lines.join(F.broadcast(numbers), "event_type").select("src", "line", ts.cast("bigint").alias("ts"))
