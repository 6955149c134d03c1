"""Substring dedup by hashing paragraphs.

Units are of two kinds, cut by one rule each, whatever the text around them or its size. Lines of ``min_words`` words or more are units. As passages also
stand within and across lines, so are content-defined paragraphs: of the runs of ``PASSAGE`` words from each word on, those whose hash is the least of ``PASSAGE`` successive ones (winnowing).
Every run of 2 * ``PASSAGE`` - 1 = 51 equal words, wherever it stands, holds the same one in full, and successive ones leave no word between them out. Units
are normalised (lower case, white space runs as one blank) and hashed. Digests are grouped over the whole corpus, the occurrence of the lowest rank
(document id, place) stays, and the others are removed; units of a text that overlap or touch make one span, with its offsets in the original text.

Edge cases: null and empty texts have no units. Rows with a null document id rank last; copies among them stay. Rows that repeat an id and text count as
the same occurrence, so that none of them is the other's copy. Copies within a text count too. Very long texts have more units. An empty table gives an empty result. Extra columns are
ignored, and kept by ``without``, whatever their names, which replaces its output column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, cache, fresh, mapped, mixed, named, text_slices, written

MIN_WORDS = 20
TOKEN = re.compile(r"\S+")
#: Words of a content-defined paragraph, and successive ones of which the least is taken.
PASSAGE = 26
#: Numbers of content-defined paragraphs begin here.
WINNOWED = 1 << 30


def text_key(id_col: str, text_col: str):
    """One value for each document id and text, nulls included."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def row_key(id_col: str, text_col: str):
    """A short form of the same, for use along with the document id."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\x00"), text_col)


def lines_of(text: str | None, min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """(unit, start, end, words, digest) of the lines of ``min_words`` words or more."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n") if text else ()):
        words = line.lower().split()
        if len(words) >= max(1, min_words):
            out.append((k, at + len(line) - len(line.lstrip()), at + len(line.rstrip()), len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
        at += len(line) + 1
    return out


def winnowed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the runs of ``size`` words that are the least of ``size`` successive runs, the last of equal ones; of all where there are fewer."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    runs, width = hashes * np.uint64(0x9E3779B97F4A7C15), 1
    sums = np.zeros(n, np.uint64)
    at, left = 0, size  # runs of 1, 2, 4, ... words make up those of ``size``
    while left:
        if left & 1:
            sums = mixed(sums * np.uint64(0x9E3779B97F4A7C15) + runs[at : at + n])
            at += width
        left >>= 1
        if left:
            runs = mixed(runs[:-width] * np.uint64(0xD6E8FEB86659FD93) + runs[width:])
            width *= 2
    least = sums & ~low | low - np.arange(n, dtype=np.uint64)
    width, most = 1, min(size, n)
    while width < most:
        step = min(width, most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.unique((low - (least & low)).astype(np.int64))


def passages_of(text: str | None, size: int = PASSAGE) -> list[tuple[int, int, int, int, bytes]]:
    """(unit, start, end, words, digest) of the content-defined paragraphs of a text."""
    spans = [m.span() for m in TOKEN.finditer(text)] if text else []
    if len(spans) < size:
        return []
    words = [text[a:b].lower() for a, b in spans] if len(text.lower()) != len(text) else text.lower().split()
    kept = cache(__name__)
    if "hashes" not in kept:
        kept["hashes"] = WordHashes()
    out = []
    for k in winnowed(kept["hashes"].of(words), size).tolist():
        joined = " ".join(["", *words[k : k + size]])  # unlike any line, so that these are no copies of each other
        out.append((WINNOWED + k, spans[k][0], spans[k + size - 1][1], size, xxhash.xxh3_128_digest(joined.encode("utf-8", "surrogatepass"))))
    return out


def units(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, unit, start, end, n_words, digest) of every unit; offsets in code points."""
    kind = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for texts in text_slices(batch.column(2)):
                rows = [(*name, *u) for t in texts for name in [next(names)] for u in lines_of(t, min_words) + passages_of(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind, strict=True)], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, row long, unit int, start int, end int, n_words int, digest binary")


def later(found: DataFrame) -> DataFrame:
    """The units that have an occurrence of lower rank, with that one's document. ``found`` is read twice."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("unit"))
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    # a table of its own, so that both sides of the join are dealt out, and adaptive execution can split a hot digest
    first = written(first.select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit")), "first")
    same = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("doc_id").isNull() | (F.col("row") == F.col("first_row")) & (F.col("unit") == F.col("first_unit")))
    return found.join(first, "digest").where(~same).select("doc_id", "row", "unit", "start", "end", "first_doc_id", "first_unit")


def removed(found: DataFrame) -> DataFrame:
    """(doc_id, row, start, end, n_units, first_doc_id): the spans that go. Units that overlap or touch are one span; the kept document is that of
    its first unit."""
    place = Window.partitionBy("doc_id", "row").orderBy("start", "unit")
    # rows that repeat an id and text have the same units
    each = later(found).dropDuplicates(["doc_id", "row", "unit"])
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    begun = each.withColumn("_new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1))).withColumn("_span", F.sum("_new").over(place))
    spans = begun.groupBy("doc_id", "row", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.min_by("first_doc_id", "unit").alias("first_doc_id"))
    return spans.select("doc_id", "row", F.col("start").cast("long"), F.col("end").cast("long"), "n_units", "first_doc_id")


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "removed_spans") -> DataFrame:
    """``docs`` with the spans cut out of ``text_col``, each with a white-space character after it, and ``out_col`` (start, end in the original)."""
    keep = [f.name for f in docs.schema.fields if f.name.lower() != out_col.lower()]
    key, row, id_ = fresh(keep, "key"), fresh(keep, "row"), fresh(keep, "id")
    spans = gone.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(out_col))
    keyed = docs.select(*map(named, keep)).withColumn(key, row_key(id_col, text_col))
    joined = keyed.join(spans, (F.col(key) == F.col(row)) & keyed[id_col].cast("long").eqNullSafe(F.col(id_)), "left").select(*map(named, keep), out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans_of = iter(batch.column(batch.schema.get_field_index(out_col)).to_pylist())
            cut = [without_spans(text, next(spans_of)) for texts in text_slices(batch.column(at)) for text in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return mapped(joined, run, joined.schema)


def without_spans(text: str | None, spans: list[dict] | None) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"] + text[s["end"] : s["end"] + 1].isspace()
    return "".join([*out, text[at:]])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The removed spans of all documents."""
    return removed(written(units(docs, min_words), "units")).drop("row")
