"""The registered queries of the training-data operators, by their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, linededup, neardup, oracles, quality, secrets, substrings, tokens, warc
from .common import table, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()), langid.read_pieces(PIECES))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, BYTE_RANKS, public_tokenizers.PATTERN).select("doc_id", "secret_spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan finds by its fixed patterns, which SQL can tell too."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    judged = quality.judged(written(docs, "measured"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=2, per_cent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_binary, op2_line_dedup, op3_language_id, op4_warc_index, op5_bpe_round_trip, op6_secret_scan, op7_quality_rules, op8_near_duplicates, op9_substring_dedup, op10_decontaminate, pipeline, secret_base_spans)}
ORACLES = oracles.ORACLES
