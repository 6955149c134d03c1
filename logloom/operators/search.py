"""Search of a regular expression over whole sources.

The dialect is that of linear-time engines: Unicode classes, ``$`` and ``\\z`` at the very end only, no look-around, no back-references. Patterns whose
matches lie within lines are matched line by line on the JVM. The others see the source's true text, with all of its line feeds: those whose matches have a bounded
length in stretches, each with as much of the next one as a match may reach into; only those without such a bound take each source as one text, in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFUSED = re.compile(r"\(\?<?[=!]|\(\?P=|\(\?>|\\[1-9]|\\[kgGKXRZ]|[*+?}]\+|\(\?[a-z-]*[UR]")
#: What may match a line end, or depends on where lines or the text begin, or is no syntax of the JVM. Classes of letters, marks, numbers, punctuation and symbols are fine.
NOT_BY_LINE = re.compile(r"\\[AznrsWDHVRXBbP0xuU]|\\p(?!(?:\{[LMNPS][a-z]?\}|[LMNPS]))|\[\^|[$^]|\(\?[a-zA-Z]*[smRx]|&&|--|~~|\[\[|\[:")
#: Lines of a stretch, and characters that a match may have to be found in stretches; each line has one at least.
STRETCH_LINES = REACH = 4096


def check(pattern: str) -> None:
    bare = re.sub(r"\\\\|\\[pPxuU]\{[^}]*\}", "", pattern)
    if REFUSED.search(bare):
        raise ValueError("look-around, back-references, possessive and atomic groups aren't supported")


def translated(pattern: str) -> str:
    """The pattern for Python's ``regex`` module: ``$`` without the flag m and ``\\z`` are the text's end, ``\\s`` is Unicode's white space."""
    out, at, in_class, flags = [], 0, 0, [False]
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            nxt = pattern[at + 1]
            if nxt == "z":
                out.append(r"\Z")
            elif nxt == "s":
                out.append(r"\p{White_Space}")
            elif nxt == "S":
                out.append(r"\P{White_Space}")
            elif nxt in "xuU" and (m := re.match(r"\\[xuU]\{([0-9A-Fa-f]+)\}", pattern[at:])):
                out.append(regex.escape(chr(int(m[1], 16)), special_only=False))
                at += m.end()
                continue
            else:
                out.append(c + nxt)
            at += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            # a bracket right at the beginning is a member of the class
            if m := re.match(r"\[\^?\]", pattern[at:]):
                out.append(m[0][:-1] + r"\]")
                at += m.end()
                continue
        elif c == "(":
            flags.append(flags[-1])
            if m := re.match(r"\(\?([a-z]*)(?:-([a-z]*))?([:)])", pattern[at:]):
                on = ("m" in m[1] or flags[-1]) and "m" not in (m[2] or "")
                flags[-1] = on
                if m[3] == ")":  # holds to the end of the group around it
                    flags.pop()
                    flags[-1] = on
                    out.append(m[0])
                    at += m.end()
                    continue
        elif c == ")" and len(flags) > 1:
            flags.pop()
        elif c == "$" and not flags[-1]:
            c = r"\Z"
        out.append(c)
        at += 1
    return "".join(out)


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(translated(pattern), regex.V1)


def _width(pattern: str) -> tuple[int, int | None]:
    """Characters that a match has at least and at most; None for no bound, or none that is known."""
    from re import _parser

    plain = re.sub(r"\\[pP](?:\{[^}]*\}|[A-Z])", "a", translated(pattern))
    plain = re.sub(r"\\[ABbZ]", "", plain)
    try:
        least, most = _parser.parse(plain).getwidth()
    except (re.error, OverflowError, RecursionError):
        return 0, None
    return least, most if most < 1 << 31 else None


def by_line(pattern: str) -> bool:
    """Whether matching line by line on the JVM gives the same matches as matching the whole text."""
    bare = re.sub(r"\\\\", "", pattern)
    return not NOT_BY_LINE.search(bare) and "\n" not in pattern and "\r" not in pattern and _width(pattern)[0] > 0


def java(pattern: str) -> Column:
    """The pattern with Unicode classes, and only the line feed as line end."""
    return F.lit(f"(?Ud){pattern}")


def spans(found: regex.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Matches that begin from ``start`` up to ``end``; an empty one right after a match doesn't count."""
    last = -1
    for m in found.finditer(text, pos=start):
        if m.start() >= end:
            return
        if m.end() > m.start() or m.start() != last:
            yield m.span()
        last = m.end()


def _texts(lines: DataFrame, by: str, raw: str, stretch: Column) -> DataFrame:
    """(by, stretch, first, text) with the line feeds that the lines have; without a column ``fed``, all but a source's last line are taken to have one."""
    fed = F.col("fed") if "fed" in lines.columns else F.lead(F.lit(True), 1, False).over(Window.partitionBy(by).orderBy("line"))
    rows = lines.select(by, "line", F.col(raw).alias("raw"), fed.alias("fed"))
    rows = rows.select(by, stretch.alias("stretch"), "line", F.concat("raw", F.when(F.col("fed"), "\n").otherwise("")).alias("raw"))
    held = rows.groupBy(by, "stretch").agg(F.min("line").alias("first"), F.sort_array(F.collect_list(F.struct("line", "raw"))).alias("rows"))
    return held.select(by, "stretch", "first", F.array_join(F.col("rows")["raw"], "").alias("text"))


def _counted(text: str, first: int, places: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Matches by the line in which they begin."""
    line, at, counts = first, 0, {}
    for start, _ in places:
        line += text.count("\n", at, start)
        at = start
        counts[line] = counts.get(line, 0) + 1
    return counts


def _in_stretches(lines: DataFrame, pattern: str, by: str, raw: str, most: int) -> DataFrame:
    """Each stretch is searched with the beginning of the next one. Where a match reaches into the next stretch, that one is searched again from the match's
    end on, until no stretch begins elsewhere than before."""
    from ..plans.storage import stored

    kind = dict(lines.dtypes)[by]
    own = stored(_texts(lines, by, raw, F.floor(F.col("line") / STRETCH_LINES)))
    after = own.select(F.col(by).alias("_by"), (F.col("stretch") - 1).alias("_stretch"), F.substring("text", 1, most + 1).alias("after"))
    texts = stored(own.join(after, F.col(by).eqNullSafe(F.col("_by")) & (F.col("stretch") == F.col("_stretch")), "left").select(by, "stretch", "first", "text", F.coalesce("after", F.lit("")).alias("after"), F.col("after").isNotNull().alias("goes_on")))
    schema = f"`{by}` {kind}, stretch bigint, begin bigint, over bigint, line bigint, matches bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = compiled(pattern)
        for batch in batches:
            rows = []
            for src, stretch, first, text, rest, begin in zip(batch[by], batch["stretch"], batch["first"], batch["text"], batch["after"], batch["begin"], strict=True):
                # what is before a stretch is a line feed
                before = "\n" if stretch > 0 else ""
                places = [(a, b) for a, b in spans(found, before + text + rest, len(before) + int(begin), len(before) + len(text) + (not rest))]
                over = max(0, places[-1][1] - len(before) - len(text)) if places else 0
                rows += [(src, stretch, begin, over, line, n) for line, n in _counted(before + text, first - len(before), iter(places)).items()] or [(src, stretch, begin, 0, None, 0)]
            yield pd.DataFrame(rows, columns=[by, "stretch", "begin", "over", "line", "matches"]).astype({"line": "Int64"})

    def begins(found: DataFrame) -> DataFrame:
        return found.select(F.col(by).alias("_by"), (F.col("stretch") + 1).alias("_stretch"), F.col("over").alias("_begin")).distinct()

    result = stored(texts.withColumn("begin", F.lit(0).cast("bigint")).mapInPandas(run, schema))
    while True:
        told = texts.join(begins(result), F.col(by).eqNullSafe(F.col("_by")) & (F.col("stretch") == F.col("_stretch")), "left").withColumn("begin", F.coalesce("_begin", F.lit(0)).cast("bigint"))
        now = result.select(F.col(by).alias("_now"), F.col("stretch").alias("_at"), F.col("begin").alias("_was")).distinct()
        stale = told.drop("_by", "_stretch", "_begin").join(now, F.col(by).eqNullSafe(F.col("_now")) & (F.col("stretch") == F.col("_at"))).where(F.col("begin") != F.col("_was")).drop("_now", "_at", "_was")
        stale = stored(stale)
        if stale.isEmpty():
            return result.where(F.col("matches") > 0).select(by, "line", "matches")
        gone = stale.select(F.col(by).alias("_by"), F.col("stretch").alias("_stretch"))
        kept = result.join(gone, F.col(by).eqNullSafe(F.col("_by")) & (F.col("stretch") == F.col("_stretch")), "left_anti")
        result = stored(kept.unionByName(stale.mapInPandas(run, schema)))


def match_counts(lines: DataFrame, pattern: str, by: str = "src", raw: str = "raw") -> DataFrame:
    """(src, line, matches) of the lines in which a match begins. A match at the very end, after a last line feed, counts for the line after it."""
    check(pattern)
    if by_line(pattern):
        return lines.where(F.rlike(raw, java(pattern))).select(by, "line", F.regexp_count(raw, java(pattern)).cast("bigint").alias("matches"))
    compiled(pattern)  # an error now instead of in tasks
    _, most = _width(pattern)
    if most is not None and most <= REACH and not re.search(r"\\[Az]|\$|\^", pattern):
        return _in_stretches(lines, pattern, by, raw, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = compiled(pattern)
        for batch in batches:
            rows = [(src, line, n) for src, first, text in zip(batch[by], batch["first"], batch["text"], strict=True) for line, n in _counted(text, first, spans(found, text, 0, len(text) + 1)).items()]
            yield pd.DataFrame(rows, columns=[by, "line", "matches"])

    return _texts(lines, by, raw, F.lit(0)).select(by, "first", "text").mapInPandas(run, f"`{by}` {dict(lines.dtypes)[by]}, line bigint, matches bigint")


def search_lines(lines: DataFrame, pattern: str, cap: int | None = None, by: str = "src", raw: str = "raw") -> DataFrame:
    """(src, line) of lines with a match; the first ``cap`` of each source, if given."""
    hits = match_counts(lines, pattern, by, raw).select(by, "line")
    if cap is None:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("line"))).where(F.col("_n") <= cap).drop("_n")


def search_total(lines: DataFrame, pattern: str, by: str = "src", raw: str = "raw") -> DataFrame:
    """(src, total): all matches, whatever the cap."""
    check(pattern)
    if by_line(pattern):
        return lines.groupBy(by).agg(F.sum(F.regexp_count(raw, java(pattern))).cast("bigint").alias("total")).where(F.col("total") > 0)
    return match_counts(lines, pattern, by, raw).groupBy(by).agg(F.sum("matches").cast("bigint").alias("total"))
