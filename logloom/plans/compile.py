"""Clauses to one boolean column, native parts first."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsonfields import extract_field, path_matches
from ..functions.tokens import contains, matches
from .query import Bare, Clause, Field, parse_query


def clause_column(clause: Clause, line: Column) -> Column:
    """A word, a plain field (its first token at any depth), or a dotted path (verified by parsing)."""
    if isinstance(clause, Bare):
        return contains(line, clause.word)
    if len(clause.path) == 1:
        return matches(extract_field(line, clause.path[0]), clause.op, clause.value)
    return path_matches(line, clause.path, clause.op, clause.value)


def compiled(query: str | Iterable[Clause], line: Column) -> Column:
    """All clauses; true for none. Clauses that need Python come last, and see only lines that pass the others."""
    clauses = parse_query(query) if isinstance(query, str) else list(query)
    dotted = lambda c: isinstance(c, Field) and len(c.path) > 1
    native = reduce(Column.__and__, (clause_column(c, line) for c in clauses if not dotted(c)), F.lit(True))
    seen = line if all(map(dotted, clauses)) else F.when(native, line)
    return reduce(Column.__and__, (clause_column(c, seen) for c in clauses if dotted(c)), native)
