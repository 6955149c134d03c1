"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; other columns pass through them too.

Nulls, empty and very long texts, ties and repeated rows are handled as each operator states: a null or empty text fails the quality rules, rows that repeat an id
and text go or stay together, and rows without an id are no near duplicates of others. Empty tables give empty tables. Columns besides those of ``documents`` keep their names and values, whatever
they are called: operators see them under names that none of them uses. Line dedup keeps ``n_chars`` in step with the text, and
drops documents of which it leaves no line; documents that had none before stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, decontaminate, linededup, neardup, quality
from logloom.llm.common import table, written

#: Ids of documents to drop are broadcast up to this number, and joined from there on.
BROADCAST_IDS = 400_000
#: Lines too short to count as a repeated run go from this number of copies on, but the first.
SHORT_COPIES = 3


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but its OWN ones under other names, and the way back."""
    names = [c if c in OWN else f"aside {k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda done: done.select(*(F.col(f"`{n}`") for n in names)).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive limits of their language and source; null ones of these are groups too."""
    own, back = set_aside(docs)
    return back(quality.verdicts(own).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of lines and of short lines that are boilerplate."""
    own, back = set_aside(docs)
    done = linededup.deduplicated(own, short_copies=SHORT_COPIES)
    emptied = (F.size("removed_runs") > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    out = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed_runs") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more. Of rows that repeat an id all stay or go."""
    own, back = set_aside(docs)
    gone = written(neardup.groups(own, k=5, per_cent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return back(own.join(gone, own["doc_id"] == F.col("gone"), "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; all of them if there is no item."""
    own, back = set_aside(docs)
    return back(decontaminate.flagged(own, table(spark, sf_dir, "benchmark"), out_col="leaks").where(F.size("leaks") == 0))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text again; a null text has no ids."""
    done = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
