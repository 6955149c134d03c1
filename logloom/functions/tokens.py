"""Predicates on raw tokens, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Op, fold

#: Decimal numbers as the filter language reads them.
NUMBER = r"^[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"
_NUMBER = re.compile(NUMBER.replace("$", r"\Z"), re.I | re.A)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` has it. Filters would make it anew each time."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def folded(c: Column) -> Column:
    """A to Z in lower case; lower() would change other letters too."""
    return F.translate(c, _UPPER, _LOWER)


def contains(c: Column, word: str) -> Column:
    """Substring but for ASCII case. An empty word is in every text."""
    return F.contains(folded(c), F.lit(fold(word)))


def number_of(text: str) -> float | None:
    return float(text) if _NUMBER.match(text) else None


def number(c: Column) -> Column:
    """The token as double; null where it isn't a number."""
    return F.when(F.rlike(c, F.lit(f"(?i){NUMBER}")), c.try_cast("double"))


def compared(c: Column, op: Op, target: str) -> Column:
    """Numeric comparison; false for null and NaN."""
    t = number_of(target)
    if t is None or t != t:
        return F.lit(False)
    test = {Op.GT: c > t, Op.GE: c >= t, Op.LT: c < t, Op.LE: c <= t}[op]
    return F.coalesce(test & ~F.isnan(c), F.lit(False))


def matches(token: Column, op: Op, target: str) -> Column:
    """Equality and prefix but for ASCII case; numeric comparisons of tokens that are numbers. False for no token."""
    if op is Op.EQ:
        return F.coalesce(folded(token) == fold(target), F.lit(False))
    if op is Op.PREFIX:
        return F.coalesce(F.startswith(folded(token), F.lit(fold(target))), F.lit(False))
    return once(token, lambda t: once(number(t), lambda n: compared(n, op, target)))


def matches_value(value, op: Op, target: str) -> bool:
    """The same for a parsed JSON value: its display for equality and prefix, numbers only for comparisons."""
    from .strictjson import display

    if op in (Op.EQ, Op.PREFIX):
        shown = fold(display(value))
        return shown == fold(target) if op is Op.EQ else shown.startswith(fold(target))
    t = number_of(target)
    if t is None or isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    n = float(value)
    return {Op.GT: n > t, Op.GE: n >= t, Op.LT: n < t, Op.LE: n <= t}[op]
