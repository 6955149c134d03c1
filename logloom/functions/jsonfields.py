"""Fields of JSON lines: by pattern (any depth), by a scan of the outermost object, and by strict parsing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Op
from . import strictjson
from .tokens import matches, matches_value, once


def quoted(key: str) -> str:
    """The key as a literal within a Java pattern."""
    return re.sub(r"([^A-Za-z0-9_\u0080-\U0010ffff])", r"\\\1", key)


_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[^,} \t"][^,} \t]*+|(?=[,}])'


def field_pattern(key: str) -> str:
    """``"key":`` after ``{`` or ``,``, at any depth; group 1 is the value's token, with quotes. The value is looked ahead at, so that keys
    within it are found as well."""
    return rf'(?s)[{{,][ \t]*"{quoted(key)}":(?=[ \t]*({_TOKEN}))'


def unquoted(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit('"')), F.substr(token, F.lit(2), F.char_length(token) - 2)).otherwise(token)


def field_tokens(line: Column, key: str) -> Column:
    """All tokens of the key, in order."""
    return F.regexp_extract_all(line, F.lit(field_pattern(key)), F.lit(1))


def extract_field(line: Column, key: str) -> Column:
    """The first token of the key, without quotes, escapes left in; null if there is none."""
    # group 1 has the colon too, and so isn't empty where there is a token
    found = F.regexp_extract(line, rf'(?s)[{{,][ \t]*"{quoted(key)}"(:[ \t]*(?:{_TOKEN}))', 1)
    return once(found, lambda x: F.when(x != "", once(F.regexp_replace(x, "^:[ \t]*", ""), unquoted)))


def any_field_matches(line: Column, key: str, op: Op, target: str) -> Column:
    return F.coalesce(F.exists(field_tokens(line, key), lambda t: matches(unquoted(t), op, target)), F.lit(False))


FIELD = T.StructType([T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("has_escapes", T.BooleanType())])
_PART = re.compile(r'"((?:[^"\\]|\\.)*)"|(["{}\[\]])', re.S)
_COLON = re.compile(r"[ \t]*:[ \t]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_NUMBER = re.compile(r"[-0-9][-+0-9.eE]*")


def scan(line: str | None, key: str) -> tuple[str, str, bool] | None:
    """(kind, raw, has_escapes) of a key of the outermost brackets; text around and cut-off ends are tolerated."""
    depth = 0
    for m in _PART.finditer(line or ""):
        mark = m[2]
        if mark is None:
            if depth == 1 and m[1] == key and (colon := _COLON.match(line, m.end())):
                return _value(line, colon.end())
        elif mark == '"':
            return None
        else:
            depth += 1 if mark in "{[" else -1
    return None


def _value(line: str, at: int) -> tuple[str, str, bool] | None:
    first = line[at : at + 1]
    if first == '"':
        m = _STRING.match(line, at)
        return m and ("Str", m[1], "\\" in m[1])
    if first in ("{", "["):
        return "Nested", "", False
    for word, kind in (("true", "Bool"), ("false", "Bool"), ("null", "Null")):
        if line.startswith(word, at):
            return kind, word, False
    m = _NUMBER.match(line, at)
    return m and ("Num", m[0], False)


def scan_field(line: Column, key: str) -> Column:
    """struct(kind, raw, has_escapes) of an outermost key; null if there is none."""

    @F.pandas_udf(FIELD)
    def found(lines: pd.Series) -> pd.DataFrame:
        rows = [scan(x, key) or (None, None, None) for x in lines]
        return pd.DataFrame(rows, columns=["kind", "raw", "has_escapes"])

    got = found(line)
    return F.when(got["kind"].isNotNull(), got)


def is_object(line: Column) -> Column:
    """Whether the whole line is one JSON object."""

    @F.pandas_udf("boolean")
    def test(lines: pd.Series) -> pd.Series:
        return pd.Series([isinstance(strictjson.parse(x), dict) for x in lines], dtype=bool)

    return test(line)


def cell(line: Column, *path: str) -> Column:
    """The display of what a path leads to (of the whole line for no path); null if the line isn't JSON or the path leads nowhere."""

    @F.pandas_udf("string")
    def shown(lines: pd.Series) -> pd.Series:
        values = (strictjson.parse(x) for x in lines)
        found = [v if v is strictjson.NO_VALUE else strictjson.navigate(v, path) for v in values]
        return pd.Series([None if v is strictjson.NO_VALUE else strictjson.display(v) for v in found], dtype=object)

    return shown(line)


def path_matches(line: Column, path: tuple[str, ...], op: Op, target: str) -> Column:
    """The dotted clause: a cheap test of the last key's tokens first, then strict parsing of the lines that pass."""

    @F.pandas_udf("boolean")
    def verified(lines: pd.Series) -> pd.Series:
        out = []
        for x in lines:
            v = strictjson.parse(x)
            v = v if v is strictjson.NO_VALUE else strictjson.navigate(v, path)
            out.append(v is not strictjson.NO_VALUE and matches_value(v, op, target))
        return pd.Series(out, dtype=bool)

    coarse = any_field_matches(line, path[-1], op, target)
    return coarse & verified(F.when(coarse, line))


SUB_ROWS = T.ArrayType(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


def flatten(line: Column) -> Column:
    """array(struct(depth, label, value)) of the nested fields; empty for anything but an object with some."""

    @F.pandas_udf(SUB_ROWS)
    def rows(lines: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("depth", "label", "value"), r, strict=True)) for r in strictjson.flattened(strictjson.parse(x))] for x in lines], dtype=object)

    return rows(line)


def is_expandable(line: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(lines: pd.Series) -> pd.Series:
        return pd.Series([strictjson.expandable(strictjson.parse(x)) for x in lines], dtype=bool)

    return test(line)


KEYS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("width", T.IntegerType())]))
WIDEST, PROBED_BYTES = 32, 256


def value_width(value) -> int:
    """Characters of the display, 33 for anything wider than can be shown."""
    if isinstance(value, str):
        return min(len(value), WIDEST + 1)
    shown = strictjson.compact_prefix(value, PROBED_BYTES)
    return WIDEST + 1 if shown is None else len(shown)


def keys(line: Column) -> Column:
    """array(struct(name, width)) of an object's keys in order; empty for anything else."""

    @F.pandas_udf(KEYS)
    def found(lines: pd.Series) -> pd.Series:
        values = (strictjson.parse(x) for x in lines)
        return pd.Series([[{"name": k, "width": max(min(len(k), WIDEST + 1), value_width(x))} for k, x in v.items()] if isinstance(v, dict) else [] for v in values], dtype=object)

    return found(line)
