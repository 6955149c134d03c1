"""The filter language: blank-separated clauses that must all hold.

``word`` is a substring; ``field=value``, ``field=pre*``, ``field>=5`` and the like compare a field. Dots in a field's name lead
into nested objects. There are no quotes, no OR, no NOT.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum


class Op(Enum):
    EQ = "="
    PREFIX = "=*"
    GT = ">"
    GE = ">="
    LT = "<"
    LE = "<="


#: Order in which operators are looked for over the whole token; the first found splits it.
SEARCH_ORDER = (Op.GE, Op.LE, Op.GT, Op.LT, Op.EQ)
#: Unicode white space; control characters 1C to 1F aren't part of it.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@dataclass(frozen=True)
class Bare:
    word: str


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    op: Op
    value: str


Clause = Bare | Field


def parse_clause(token: str) -> Clause:
    for op in SEARCH_ORDER:
        name, found, value = token.partition(op.value)
        if not found:
            continue
        path = tuple(p for p in name.split(".") if p)
        if not path:
            return Bare(token)
        if op is Op.EQ and value.endswith("*"):
            return Field(path, Op.PREFIX, value[:-1])
        return Field(path, op, value)
    return Bare(token)


def parse_query(text: str) -> list[Clause]:
    return [parse_clause(t) for t in BLANKS.split(text) if t]


def fold(text: str) -> str:
    """A to Z in lower case, nothing else."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def with_known_keys(clauses: Iterable[Clause], columns: Iterable[str]) -> list[Clause]:
    """Undotted field names as the first column spells them that is equal but for ASCII case."""
    spelled: dict[str, str] = {}
    for c in columns:
        spelled.setdefault(fold(c), c)
    return [replace(c, path=(spelled.get(fold(c.path[0]), c.path[0]),)) if isinstance(c, Field) and len(c.path) == 1 else c for c in clauses]
