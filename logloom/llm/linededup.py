"""Line dedup by a suffix array over line ids.

Every document is a sequence of line ids; lines without a word aren't part of it. Prefix doubling ranks all positions by their first
1, 2, 4, … lines: in each round the pair of a position's rank and that of the position as many lines on is
replaced by the pair's place in the sorted order of all pairs, so that ranks keep the order of the suffixes. Positions
whose pair is unique leave the rounds, as no repeated run goes on there; rounds end when no pair repeats.

Positions of equal rank are an interval of the suffix array whose longest common prefix has that many lines at least. Intervals of the lengths between
two powers of two are found by halving: within an interval, positions that also share their next 2**j lines, for j downward, form an interval
of its own inside. Its earliest position stays in the outer one too, for all of them, as it shares as much with any other position there as they do. So
each position comes to its longest run that occurs earlier in the corpus (by document id, then place), and to that run's first copy. Intervals whose positions all have the same line
before them hold no maximal run, and are left out: the one that begins a line earlier holds them.

Runs count from ``min_words`` words on. Their later copies are deleted, the first stays; maximal runs of deleted lines are reported, each with the document that
its beginning is a copy of. With ``short_copies``, lines of fewer than ``min_words`` words that occur that often in the corpus are boilerplate,
whatever stands around them: all copies but the first go too.

Edge cases: null and empty texts have no lines; a null text stays null. Rows with a null document id rank last. Rows that repeat an id and text
are one document and are treated alike. Copies within a document count too. Lines are compared without white space at their ends; very long texts have as many rounds
as the longest repeated run needs. Other columns stay, whatever their names; columns named as an output column are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, mapped, named, packed, shuffle_partitions, text_slices, written
from .substrings import text_key

MIN_WORDS = 8
RUNS = "array<struct<first:long,last:long,copy_of:long>>"


def worded_lines(text: str | None) -> list[tuple[int, str, int]]:
    """(line number, line without white space at its ends, words) of the lines that have a word."""
    if not text:
        return []
    found = ((k, line.strip(" \t\n\v\f\r")) for k, line in enumerate(text.split("\n")))
    return [(k, line, len(WORD.findall(line))) for k, line in found if line]


def needed(words: list[int], min_words: int) -> list[int | None]:
    """From each line on, the fewest lines with ``min_words`` words together; None if there aren't as many."""
    out: list[int | None] = []
    end, total = 0, 0
    for k, n in enumerate(words):
        while total < min_words and end < len(words):
            total += words[end]
            end += 1
        out.append(end - k if total >= min_words else None)
        total -= n
    return out


def sequences(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, pos, need, line): a line's place among the lines that have words, how many from it on are a run that counts, and its digest."""
    kind = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("need", pa.int64()), ("line", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for texts in text_slices(batch.column(2)):
                out: list[list] = [[] for _ in kind]
                for text in texts:
                    row, doc = next(names)
                    lines = worded_lines(text)
                    least = needed([n for _, _, n in lines], min_words)
                    digests = [hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, line, _ in lines]
                    for c, v in zip(out, ([row] * len(lines), [doc] * len(lines), range(len(lines)), least, digests), strict=True):
                        c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    named = docs.select(F.unhex(text_key(id_col, text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(named, run, "row binary, doc_id long, pos long, need long, line binary")


def places(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, place) of the keys that occur twice or more: their ranks, with gaps.

    Distinct keys are sorted over all tasks by ranges; ids that ascend over partitions and rows are in their order.
    """
    twice = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys)
    dealt = twice.repartitionByRange(shuffle_partitions(keyed.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.withColumn("place", F.monotonically_increasing_id())


def suffix_ranks(seq: DataFrame) -> list[DataFrame]:
    """Tables (row, doc_id, pos, need, prev, rank, up) by 1, 2, 4, … lines, until no rank repeats.

    ``rank`` is that of the first 2**k lines, which others have too, ``up`` that of twice as many, null if no other position has them; ``prev`` is the rank of the
    line before, null if there is none or only one such line.
    """
    place = Window.partitionBy("row").orderBy("pos")
    at = lambda lines: F.first("rank").over(place.rangeBetween(lines, lines))
    now, levels = seq.join(places(seq, ["line"]), "line").select("row", "doc_id", "pos", "need", F.col("place").alias("rank")), []
    n = seq.count()
    while True:
        lines = 1 << len(levels)
        # a next that repeats nowhere is a number of its own below zero, so that such rows of a frequent rank are dealt out
        alone = -1 - F.pmod(F.xxhash64("row", "pos"), F.lit(1 << 62))
        prev = F.col("prev") if levels else at(-1).alias("prev")
        keyed = written(packed(now.select("row", "doc_id", "pos", "need", prev, "rank", F.coalesce(at(lines), alone).alias("next")), n), f"pairs-{lines}")
        known = places(keyed.where(F.col("next") >= 0), ["rank", "next"])
        levels.append(written(packed(keyed.join(known, ["rank", "next"], "left").select("row", "doc_id", "pos", "need", "prev", "rank", F.col("place").alias("up")), n), f"ranks-{lines}"))
        now = levels[-1].where(F.col("up").isNotNull()).select("row", "doc_id", "pos", "need", "prev", F.col("up").alias("rank"))
        n = now.count()
        if not n:
            return levels


def _order() -> Column:
    """A position's place in the corpus."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("pos"))


def _is_first() -> Column:
    return (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))


_MEMBER = ("interval", "k", "lines", "row", "doc_id", "pos", "need", "prev", "target")


def _intervals(levels: list[DataFrame]) -> DataFrame:
    """Members of the intervals of 2**k lines: positions of which no other shares twice as many lines, and for each interval of twice as many
    the earliest position in it, as the others there have longer runs that occur earlier. All are targets, if a run of less than twice as many lines may count."""
    out = []
    for k, level in enumerate(levels):
        last = level.where(F.col("up").isNull()).select("row", "doc_id", "pos", "need", "prev", "rank")
        first = level.where(F.col("up").isNotNull()).groupBy("up").agg(F.min(_order()).alias("at"), F.min_by(F.struct("need", "prev", "rank"), _order()).alias("of"))
        named = last.unionByName(first.select("at.row", "at.doc_id", "at.pos", "of.need", "of.prev", "of.rank")).withColumn("interval", F.unhex(F.md5(F.concat_ws(" ", F.lit(str(k)), F.col("rank").cast("string")))))
        target = F.coalesce(F.col("need") < 2 << k, F.lit(False)).alias("target")
        out.append(named.select("interval", F.lit(k).alias("k"), F.lit(1 << k).cast("long").alias("lines"), "row", "doc_id", "pos", "need", "prev", target))
    return reduce(DataFrame.unionByName, out)


def _told(members: DataFrame, n: int) -> DataFrame:
    """(interval, first, fine) of the intervals of two members or more; fine ones have a target and may hold maximal runs."""
    found = members.groupBy("interval").agg(F.min(_order()).alias("first"), F.count("*").alias("n"), F.bool_or("target").alias("wanted"), F.count("prev").alias("n_prev"), F.min("prev").alias("low"), F.max("prev").alias("high"))
    fine = F.col("wanted") & ((F.col("n_prev") < F.col("n")) | (F.col("low") != F.col("high")))
    # a table of its own, so that both sides of joins are dealt out, and adaptive execution can split a hot interval
    return written(packed(found.where(F.col("n") > 1).select("interval", "first", fine.alias("fine")), n), "intervals")


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(row, start, lines, copy_of): for targets, the runs of ``lines`` lines from ``start`` on that occur earlier, longest ones included, if they count, and
    the document of the first copy."""
    later = lambda rows: rows.where(F.col("target") & (F.col("lines") >= F.col("need")) & ~_is_first()).select("row", F.col("pos").alias("start"), "lines", F.col("first.doc_id").alias("copy_of"))
    members = written(_intervals(levels), "members")
    n = members.count()
    live = written(packed(members.join(_told(members, n).where("fine"), "interval"), n), "live")
    out, active = [later(live)], None
    for j in range(len(levels) - 2, -1, -1):
        fresh = live.where(F.col("k") == j + 1).select(*_MEMBER)
        active = fresh if active is None else active.unionByName(fresh)
        ahead = levels[j].select(F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("rank").alias("_rank")).distinct()
        joined = active.join(ahead, (F.col("row") == F.col("_row")) & (F.col("pos") + F.col("lines") == F.col("_pos")), "left")
        inner = F.unhex(F.md5(F.concat_ws(" ", F.hex("interval"), F.lit(str(j)), F.col("_rank").cast("string"))))
        n = active.count()
        rows = written(packed(joined.select(*_MEMBER, F.when(F.col("_rank").isNotNull(), inner).alias("inner")), n), "halved")
        moving = rows.where(F.col("inner").isNotNull()).withColumn("outer", F.col("interval")).withColumn("interval", F.col("inner")).withColumn("lines", F.col("lines") + (1 << j))
        told = _told(moving, n)
        if told.isEmpty():  # no two share as many lines
            active = rows.select(*_MEMBER)
            continue
        moved = written(packed(moving.join(told, "interval"), n), "moved")
        out.append(later(moved.where("fine")))
        stays = rows.join(told.select(F.col("interval").alias("inner")), "inner", "left_anti").select(*_MEMBER)
        partner = moved.where(_is_first()).withColumn("interval", F.col("outer")).withColumn("lines", F.col("lines") - (1 << j)).select(*_MEMBER)
        active = written(packed(stays.unionByName(partner).unionByName(moved.where("fine").select(*_MEMBER)), 2 * n), "active")
    return reduce(DataFrame.unionByName, out).distinct()


def later_short_lines(level: DataFrame, copies: int) -> DataFrame:
    """(row, start, lines, copy_of) of the later copies of lines too short to count alone that occur ``copies`` times or more."""
    short = level.where(F.coalesce(F.col("need") > 1, F.lit(True))).dropDuplicates(["row", "pos"])
    first = short.groupBy("rank").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where(F.col("n") >= copies)
    again = short.join(written(first.select("rank", "first"), "short-lines"), "rank").where(~_is_first())
    return again.select("row", F.col("pos").alias("start"), F.lit(1).cast("long").alias("lines"), F.col("first.doc_id").alias("copy_of"))


def cut(text: str | None, gone: list[dict] | None) -> tuple[str | None, list[dict], int]:
    """The text without the lines of the runs, the maximal runs that went as line numbers, and the number of lines with words."""
    lines = worded_lines(text)
    if not gone:
        return text, [], len(lines)
    source: dict[int, int | None] = {}
    for b in sorted(gone, key=lambda b: (b["start"], -b["lines"])):
        for k in range(b["start"], b["start"] + b["lines"]):
            source.setdefault(k, b["copy_of"])
    numbers = {lines[k][0] for k in source}
    runs: list[dict] = []
    for k in sorted(source):
        if k - 1 in source:
            runs[-1]["last"] = lines[k][0]
        else:
            runs.append({"first": lines[k][0], "last": lines[k][0], "copy_of": source[k]})
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in numbers), runs, len(lines)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", short_copies: int | None = None, runs_col: str = "removed_runs", lines_col: str = "n_lines") -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of ``text_col``, and ``runs_col`` and ``lines_col`` (lines with words of the original) as last columns."""
    seq = written(sequences(docs, min_words, id_col, text_col), "lines")
    levels = suffix_ranks(seq)
    later = longest_earlier(levels)
    if short_copies is not None:
        later = later.unionByName(later_short_lines(levels[0], short_copies))
    keep = [f.name for f in docs.schema.fields if f.name.lower() not in (runs_col.lower(), lines_col.lower())]
    gone_col, key, row = fresh(keep, "gone"), fresh(keep, "key"), fresh(keep, "row")
    gone = later.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("start", "lines", "copy_of")).alias(gone_col))
    joined = docs.select(*map(named, keep)).withColumn(key, F.unhex(text_key(id_col, text_col))).join(gone, F.col(key) == F.col(row), "left").drop(key, row)
    schema = docs.select(*map(named, keep), F.lit(None).cast(RUNS).alias(runs_col), F.lit(None).cast("long").alias(lines_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            gone_of = iter(batch.column(batch.schema.get_field_index(gone_col)).to_pylist())
            done = [cut(text, next(gone_of)) for texts in text_slices(batch.column(at)) for text in texts]
            arrays = [pa.array([t for t, _, _ in done], pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in keep]
            runs = pa.array([r for _, r, _ in done], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("copy_of", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*arrays, runs, pa.array([n for _, _, n in done], pa.int64())], names=[*keep, runs_col, lines_col])

    return mapped(joined, run, schema)


def digest(done: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines with words), the runs as `first-last` and the SHA-256 of the rest."""
    # each run's lines without words stay, so that the lines that went are counted from what is left
    runs = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))).cast("long")
    return done.select("doc_id", "n_lines", (F.col("n_lines") - left).alias("n_removed"), runs.alias("removed_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
