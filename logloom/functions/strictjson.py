"""Strict JSON of one line, and its compact display.

Strict means: no trailing text, no NaN or Infinity, no number beyond double range, no lone surrogates, nesting below 128. Objects keep
the order of first keys, and the last value of a repeated one. Integers beyond 64 bits are doubles.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

MOST_DEPTH = 127
SURROGATE = re.compile("[\ud800-\udfff]")
NO_VALUE = object()


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def _integer(text: str) -> int | float:
    if text == "-0":
        return -0.0
    value = int(text) if len(text) < 25 else 1 << 70
    return value if -(1 << 63) <= value < 1 << 64 else _double(text)


def _double(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(text)
    return value


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer, parse_float=_double)


def _too_deep(text: str) -> bool:
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.S):
        if m[0] in "[{":
            depth += 1
            if depth > MOST_DEPTH:
                return True
        elif m[0] in "]}":
            depth -= 1
    return False


def parse(line: str | None) -> Any:
    """The value, or NO_VALUE where the line isn't strict JSON."""
    if not line:
        return NO_VALUE
    text = line.strip(" \t\n\r")
    try:
        if text.count("[") + text.count("{") > MOST_DEPTH and _too_deep(text):
            return NO_VALUE
        value = _decoder.decode(text)
    except (ValueError, RecursionError):
        return NO_VALUE
    return NO_VALUE if "\\u" in text and SURROGATE.search(json.dumps(value, ensure_ascii=False)) else value


def number(value: int | float) -> str:
    """Shortest digits; plain between 1e-5 and 1e16, else with a bare exponent."""
    if isinstance(value, int):
        return str(value)
    sign, digits, exponent = re.fullmatch(r"(-?)([0-9.]+)(?:e([+-]?[0-9]+))?", repr(value)).groups()
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    raw = (whole + part).lstrip("0")
    if not raw:
        return f"{sign}0.0"
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(raw))
    raw = raw.rstrip("0")
    if len(raw) <= point <= 16:
        return f"{sign}{raw}{'0' * (point - len(raw))}.0"
    if 0 < point <= 16:
        return f"{sign}{raw[:point]}.{raw[point:]}"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{raw}"
    return f"{sign}{raw[0]}{'.' + raw[1:] if len(raw) > 1 else ''}e{point - 1}"


def compact(value: Any) -> str:
    """JSON without blanks, keys in order."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, (bool, str)) or value is None:
        return json.dumps(value, ensure_ascii=False)
    return number(value)


def _tokens(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        yield "{"
        for k, v in value.items():
            yield json.dumps(k, ensure_ascii=False) + ":"
            yield from _tokens(v)
            yield ","
        yield "}"
    elif isinstance(value, list):
        yield "["
        for v in value:
            yield from _tokens(v)
            yield ","
        yield "]"
    elif isinstance(value, str) and len(value) > 1 << 10:
        yield '"' + value  # over any bound that is asked for
    else:
        yield compact(value)


def compact_prefix(value: Any, most_bytes: int) -> str | None:
    """The compact display if it has ``most_bytes`` at most (up to 1024), else None. No more than that is made of a large value."""
    size, parts = 0, []
    for token in _tokens(value):
        if parts and parts[-1] == "," and token in "]}":
            size -= len(parts.pop())
        parts.append(token)
        size += len(token.encode("utf-8", "surrogatepass"))
        if size > most_bytes + 1:  # a comma may go again
            return None
    return "".join(parts) if size <= most_bytes else None


def display(value: Any) -> str:
    """Strings bare, anything else compact."""
    return value if isinstance(value, str) else compact(value)


def flattened(value: Any) -> list[tuple[int, str, str]]:
    """(depth, label, display) of the nested fields of an object, in order, each before its parts; its plain fields are left out."""
    out: list[tuple[int, str, str]] = []

    def visit(label: str, v: Any, depth: int) -> None:
        out.append((depth, label, display(v)))
        inner = v.items() if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v)) if isinstance(v, list) else ()
        for name, x in inner:
            visit(name, x, depth + 1)

    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, (dict, list)):
                visit(k, v, 1)
    return out


def expandable(value: Any) -> bool:
    return isinstance(value, dict) and any(isinstance(v, (dict, list)) for v in value.values())


def navigate(value: Any, path: tuple[str, ...]) -> Any:
    """What a path leads to; array parts are indices. NO_VALUE if it leads nowhere."""
    for part in path:
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and re.fullmatch(r"\+?[0-9]+", part) and int(part) < len(value):
            value = value[int(part)]
        else:
            return NO_VALUE
    return value
