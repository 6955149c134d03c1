"""The filter language run over lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import compiled
from ..plans.query import Clause, parse_query, with_known_keys


def run_filter(lines: DataFrame, query: str | Iterable[Clause], columns: Iterable[str] | None = None, by: str = "src") -> DataFrame:
    """(src, line) of the lines on which all clauses hold. ``columns``: spell plain field names as these do."""
    return run_filter_from(lines, query, 0, columns, by)


def run_filter_from(lines: DataFrame, query: str | Iterable[Clause], start: int, columns: Iterable[str] | None = None, by: str = "src") -> DataFrame:
    """The same for lines from ``start`` on; without clauses, all of these."""
    clauses = parse_query(query) if isinstance(query, str) else list(query)
    if columns is not None:
        clauses = with_known_keys(clauses, columns)
    rows = lines.where(F.col("line") >= start) if start else lines
    return rows.where(compiled(clauses, F.col("value"))).select(by, "line")
