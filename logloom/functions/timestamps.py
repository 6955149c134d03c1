"""Timestamps at the start of a line or in a JSON field, as epoch milliseconds (bigint).

All of it is integer arithmetic: the 30th of February is the 1st or 2nd of March, second 60 is accepted. Times without a zone are
taken at ``offset_ms`` east of UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonfields

ISO, LOG4J, EPOCH_SECONDS, EPOCH_MILLIS = "iso8601", "log4j", "epoch_seconds", "epoch_millis"
LABELS = {ISO: "ISO-8601", LOG4J: "log4j (,ms)", EPOCH_SECONDS: "epoch seconds", EPOCH_MILLIS: "epoch milliseconds"}

#: A possessive fraction and look-aheads keep a bad zone or fraction from matching without it.
ISO_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.([0-9]{1,9}+)|(?!\.))(?:(Z)|([+-])([0-9]{2}):?([0-9]{2})|(?![Z+-]))"
LOG4J_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}"
MILLIS_FROM = 1_000_000_000_000


@dataclass(frozen=True)
class Parsed:
    """Milliseconds and characters used; both null where the line has no such timestamp."""

    ms: Column
    used: Column


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, linear in the day. For years from 0 on.

    Years are counted from March, so that the leap day is the last day of its year.
    """
    y = year - F.when(month <= 2, 1).otherwise(0)
    days_before_month = F.floor((153 * F.pmod(month + 9, F.lit(12)) + 2) / 5).cast("bigint")
    leap_days = F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    # 719468 days from 0000-03-01 to 1970-01-01
    return y * 365 + leap_days.cast("bigint") + days_before_month + day - 1 - 719468


def _number(line: Column, at: int, size: int) -> Column:
    return F.substring(line, at + 1, size).try_cast("bigint")


def _civil(line: Column) -> tuple[Column, Column]:
    """Milliseconds of the first 19 characters, and whether they are a valid date and time."""
    year, month, day = _number(line, 0, 4), _number(line, 5, 2), _number(line, 8, 2)
    hour, minute, second = _number(line, 11, 2), _number(line, 14, 2), _number(line, 17, 2)
    valid = month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second <= 60)
    return ((days_from_civil(year, month, day) * 24 + hour) * 60 + minute) * 60_000 + second * 1000, valid


def parse_iso(line: Column, offset_ms: int = 0) -> Parsed:
    """``YYYY-MM-DD[T ]HH:MM:SS``, a fraction of 1 to 9 digits, and ``Z``, ``±hh:mm``, ``±hhmm`` or no zone."""
    piece = lambda k: F.regexp_extract(line, ISO_PATTERN, k)
    civil, valid = _civil(line)
    fraction = F.rpad(F.substring(piece(1), 1, 3), 3, "0").try_cast("bigint")
    hours, minutes = piece(4).try_cast("bigint"), piece(5).try_cast("bigint")
    east = F.when(piece(3) == "-", -1).otherwise(1) * (hours * 60 + minutes) * 60_000
    zone = F.when(piece(2) == "Z", 0).when(piece(3) != "", F.when((hours <= 23) & (minutes <= 59), east)).otherwise(offset_ms)
    found = F.rlike(line, F.lit(ISO_PATTERN)) & valid & zone.isNotNull()
    return Parsed(F.when(found, civil + fraction - zone), F.when(found, F.char_length(piece(0))))


def parse_log4j(line: Column, offset_ms: int = 0) -> Parsed:
    """``YYYY-MM-DD HH:MM:SS,mmm``."""
    civil, valid = _civil(line)
    found = F.rlike(line, F.lit(LOG4J_PATTERN)) & valid
    return Parsed(F.when(found, civil + _number(line, 20, 3) - offset_ms), F.when(found, F.lit(23)))


def parse_epoch(line: Column, scale: int) -> Parsed:
    """All leading digits times ``scale``; null beyond 64 bits."""
    digits = F.regexp_extract(line, "^[0-9]+", 0)
    value = F.try_multiply(digits.try_cast("bigint"), F.lit(scale).cast("bigint"))
    return Parsed(value, F.when(value.isNotNull(), F.char_length(digits)))


def parse_prefix(line: Column, kind: str, offset_ms: int = 0) -> Parsed:
    if kind == ISO:
        return parse_iso(line, offset_ms)
    if kind == LOG4J:
        return parse_log4j(line, offset_ms)
    return parse_epoch(line, {EPOCH_SECONDS: 1000, EPOCH_MILLIS: 1}[kind])


def probe_format(line: Column) -> Column:
    """The format of the timestamp that a line starts with: log4j before ISO (which would take its first 19 characters), then epochs of
    9 to 11 or 12 to 14 digits before a blank or the end."""
    digits = F.char_length(F.regexp_extract(line, r"^([0-9]+)(?:[ \t]|\z)", 1))
    return (
        F.when(parse_log4j(line).ms.isNotNull(), LOG4J)
        .when(parse_iso(line).ms.isNotNull(), ISO)
        .when(digits.between(9, 11), EPOCH_SECONDS)
        .when(digits.between(12, 14), EPOCH_MILLIS)
    )


def parse_time_text(text: Column, offset_ms: int = 0, fix_log4j: bool = False) -> Column:
    """A whole text that is an ISO time. log4j times are a valid ISO prefix with a rest, and so null, unless ``fix_log4j``."""
    iso = parse_iso(text, offset_ms)
    log4j = parse_log4j(text, offset_ms)
    found = F.when(iso.used == F.char_length(text), iso.ms)
    return F.coalesce(found, F.when(log4j.used == F.char_length(text), log4j.ms)) if fix_log4j else found


def _truncated(value: Column) -> Column:
    """double to bigint, cut towards zero and held within its range."""
    most = float(1 << 63)
    return F.when(F.isnan(value), F.lit(0).cast("bigint")).when(value >= most, F.lit((1 << 63) - 1)).when(value <= -most, F.lit(-(1 << 63))).otherwise(value.try_cast("bigint"))


def field_time(field: Column, offset_ms: int = 0, fix_log4j: bool = False) -> Column:
    """Time of a scanned field: numbers from 1e12 on are milliseconds, smaller ones seconds; strings are ISO times."""
    raw = field["raw"]
    whole = F.when(F.rlike(raw, F.lit("^-?[0-9]+$")), raw.try_cast("bigint"))
    real = F.when(F.rlike(raw, F.lit(r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$")), raw.try_cast("double"))
    number = F.when(whole.isNotNull(), F.when(F.abs(whole.cast("decimal(20,0)")) >= MILLIS_FROM, whole).otherwise(F.try_multiply(whole, F.lit(1000).cast("bigint"))))
    number = F.coalesce(number, F.when(real.isNotNull(), _truncated(F.when(F.abs(real) >= float(MILLIS_FROM), real).otherwise(real * 1000.0))))
    return F.when(field["kind"] == "Num", number).when(field["kind"] == "Str", parse_time_text(raw, offset_ms, fix_log4j))


def parse_jsonl_field(line: Column, name: str, offset_ms: int = 0, fix_log4j: bool = False) -> Column:
    return field_time(jsonfields.scan_field(line, name), offset_ms, fix_log4j)
