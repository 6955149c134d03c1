"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each feature of a document is put in a bin of relative width 2 % (a logarithmic histogram: sketches merge by adding
counts, whatever the order, and a quantile is off by 1 % at most). Sketches are kept per language and source and
added up to languages and to the whole corpus. A group's limits follow from its own quantiles: the median and
``SPREAD`` times the distance between the median and the outer quartile, but never closer to the median than the
feature's ``slack``. A group with fewer than ``min_docs`` documents takes the limits of its language, and that the
corpus's. Limits are joined to the documents, and documents outside of any are rejected.

The sketches count the documents that pass the base rules (50 words, and at most half of the words in runs of three that
the text repeats); the others are rejected anyway.

Edge cases: null and empty texts have 0 for all counts and fail the base rules; null language or source is a group of
its own (null-safe); no rows give no limits and no rows; ties don't matter, repeated rows count repeatedly; columns
named as an output column are replaced, others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import fresh, mapped, named, text_slices, written

#: feature: (slack below the median or None for no lower limit, slack above it).
FEATURES = {
    "symbols": (None, 0.05),
    "dup_lines": (None, 0.35),
    "repeats": (None, 0.35),
    "word_length": (1.5, 2.0),
}
SPREAD = 4.0
MIN_DOCS = 100
GAMMA = 1.02
#: Values from here on have a bin of their own each; below is the bin of zero.
LEAST = 1e-4
#: Limits of more groups than this aren't broadcast.
BROADCAST_GROUPS = 20_000


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds textstats.FIELDS (long) to all columns."""
    keep = [f for f in df.schema.fields if f.name.lower() not in textstats.FIELDS]
    schema = T.StructType(keep + [T.StructField(n, T.LongType(), False) for n in textstats.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            rows = [textstats.stats(t) for part in text_slices(texts) for t in part]
            counts = np.array(rows, np.int64).reshape(-1, len(textstats.FIELDS))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), *(pa.array(c) for c in counts.T)], names=schema.names)

    return mapped(df, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    """Ratios of the counts; 0 where there is nothing to divide by."""
    up, down = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}[name]
    return F.when(F.col(down) > 0, F.col(up) / F.col(down)).otherwise(0.0)


def bin_of(value: Column) -> Column:
    return F.when(value < LEAST, F.lit(0)).otherwise(F.ceil(F.log(value / LEAST) / math.log(GAMMA)).cast("int") + 1)


def value_of(bin_: Column) -> Column:
    """The middle of a bin."""
    return F.when(bin_ <= 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), bin_ - 1.5))


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by…, feature, bin, n): the sketches of each group, of documents that pass the base rules."""
    bins = F.array(*(F.struct(F.lit(n).alias("feature"), bin_of(feature(n)).alias("bin")) for n in FEATURES))
    flat = measured.where(~base_failed()).select(*by, F.explode(bins).alias("b")).select(*by, "b.feature", "b.bin")
    return flat.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Adds up sketches over all columns but ``by``."""
    return sketch.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n_docs, lower and upper limit of each feature) from sketches. A group has a row for each bin that is in use, under 2000 in all."""
    group = Window.partitionBy(*by, "feature")
    ranked = sketch.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    quantile = lambda q: value_of(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))))
    quartiles = ranked.groupBy(*by, "feature").agg(F.max("total").alias("n_docs"), quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"))
    of = lambda n, c: F.max(F.when(F.col("feature") == n, c))
    out = [F.max("n_docs").alias("n_docs")]
    for name, (below, above) in FEATURES.items():
        out.append(of(name, F.col("q2") + F.greatest(F.lit(above), SPREAD * (F.col("q3") - F.col("q2")))).alias(f"{name}_most"))
        if below is not None:
            out.append(of(name, F.col("q2") - F.greatest(F.lit(below), SPREAD * (F.col("q2") - F.col("q1")))).alias(f"{name}_least"))
    return quartiles.groupBy(*by).agg(*out)


def limit_names() -> list[str]:
    return [f"{n}_most" for n in FEATURES] + [f"{n}_least" for n, (below, _) in FEATURES.items() if below is not None]


def all_limits(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, limits) of every group: its own, or its language's, or the corpus's. Written out, as it is
    read more than once."""
    by_group = written(sketches(measured.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *textstats.FIELDS), ["lang", "source"]), "sketches")
    by_lang = merged(by_group, ["lang"])
    whole = limits(merged(by_lang.withColumn("all", F.lit(1)), ["all"]), ["all"])
    langs, groups = limits(by_lang, ["lang"]), limits(by_group, ["lang", "source"])
    named = lambda df, prefix, keys: df.select(*(F.col(k).alias(f"{prefix}{k}") for k in keys), *(F.col(c).alias(f"{prefix}{c}") for c in ["n_docs", *limit_names()]))
    joined = groups.join(named(langs, "l_", ["lang"]), F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(named(whole, "w_", [])))
    pick = lambda c: F.when(F.col("n_docs") >= min_docs, F.col(c)).when(F.col("l_n_docs") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}")).alias(c)
    return written(joined.select("lang", "source", *(pick(c) for c in limit_names())), "limits")


def judged(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds base_failed and kept to a measured table, which is read twice. A group whose documents all fail the base rules has no
    limits and needs none."""
    found = all_limits(measured, lang_col, source_col, min_docs)
    keep = [c for c in measured.columns if c.lower() not in ("base_failed", "kept")]
    name = {c: fresh(keep, c) for c in ["limits_lang", "limits_source", *limit_names()]}
    found = found.select(F.col("lang").alias(name["limits_lang"]), F.col("source").alias(name["limits_source"]), *(F.col(c).alias(name[c]) for c in limit_names()))
    if found.count() <= BROADCAST_GROUPS:
        found = F.broadcast(found)
    out = measured.select(*map(named, keep)).join(found, F.col(lang_col).eqNullSafe(F.col(name["limits_lang"])) & F.col(source_col).eqNullSafe(F.col(name["limits_source"])), "left")
    inside = [feature(n) <= F.col(name[f"{n}_most"]) for n in FEATURES] + [feature(n) >= F.col(name[f"{n}_least"]) for n, (below, _) in FEATURES.items() if below is not None]
    kept = ~base_failed() & F.coalesce(reduce(Column.__and__, inside), F.lit(True))
    return out.select(*map(named, keep), base_failed().alias("base_failed"), kept.alias("kept"))


def verdicts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All columns, the counts, base_failed and kept. The measured table is written out once, with the text."""
    return judged(written(measure(df, text_col), "measured"), lang_col, source_col)
