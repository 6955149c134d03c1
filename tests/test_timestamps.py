"""Timestamp parsing and the routes found for sources."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import timestamps as T
from logloom.operators.sampling import detect_route

from test_query import lines_of

T0 = 1790467200000  # 2026-09-27T00:00:00Z


def parsed(spark, line, how):
    p = how(F.col("value"))
    r = spark.createDataFrame([(line,)], "value string").select(p.ms.alias("ms"), p.used.alias("used")).first()
    return None if r["ms"] is None else (r["ms"], r["used"])


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2026-09-27T00:00:00Z", (T0, 20)),
        ("2026-09-27T08:00:00+08:00 x", (T0, 25)),
        ("2026-09-26T21:30:00-0230", (T0, 24)),
        ("2026-09-27 00:00:00.5 rest", (T0 + 500, 21)),
        ("2026-09-27 00:00:00.123456789", (T0 + 123, 29)),
        ("2026-09-27 00:00:00,123", (T0, 19)),
        ("2026-09-27T00:00:00", (T0, 19)),
        ("2026-13-27T00:00:00Z", None),
        ("2026-09-27T25:00:00Z", None),
        ("2026-09-27X00:00:00Z", None),
        ("2026-09-27T00:00:00.Z", None),
        ("2026-09-27T00:00:00.123+xx", None),
        ("2026-09-27T00:00:00+24:00", None),
        ("2026-09-26T23:59:60Z", (T0, 20)),
        ("2026-02-30T00:00:00Z", (1772409600000, 20)),
        ("", None),
        (None, None),
    ],
)
def test_iso(spark, line, want):
    assert parsed(spark, line, T.parse_iso) == want


def test_other_formats(spark):
    assert parsed(spark, "2026-09-27 00:00:00,123 INFO", T.parse_log4j) == (T0 + 123, 23)
    assert parsed(spark, "2026-09-27 00:00:00,12", T.parse_log4j) is None
    assert parsed(spark, "1790467200 x", lambda c: T.parse_epoch(c, 1000)) == (T0, 10)
    assert parsed(spark, "99999999999999999999", lambda c: T.parse_epoch(c, 1)) is None
    assert parsed(spark, "2026-09-27 00:00:00", lambda c: T.parse_iso(c, 3_600_000)) == (T0 - 3_600_000, 19)


def test_civil_days(spark):
    import datetime

    days = [datetime.date(1, 1, 1) + datetime.timedelta(n) for n in range(0, 1_200_000, 3571)]
    rows = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "y bigint, m bigint, d bigint")
    got = [r["n"] for r in rows.select(T.days_from_civil(F.col("y"), F.col("m"), F.col("d")).alias("n")).collect()]
    assert got == [(d - datetime.date(1970, 1, 1)).days for d in days]


def test_probe(spark):
    lines = ["2026-09-27 00:00:00,123 a", "2026-09-27T00:00:00Z", "179046720 x", "1790467200000", "12345678 x", "1790467200000000", "1790467200x", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "value string").select(T.probe_format(F.col("value"))).collect()]
    assert got == ["log4j", "iso8601", "epoch_seconds", "epoch_millis", None, None, None, None]


def test_json_times(spark):
    lines = ['{"ts":"2026-09-27T00:00:00Z"}', '{"ts":1790467200}', '{"ts":1790467200000}', '{"ts":1790467200.5}', '{"ts":"2026-09-27T00:00:00Z x"}', '{"ts":true}', '{"ts":"2026-09-27 00:00:00,123"}', "{}", '{"ts":1e300}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [r[0] for r in df.select(T.parse_jsonl_field(F.col("value"), "ts")).collect()]
    assert got == [T0, T0, T0, T0 + 500, None, None, None, None, (1 << 63) - 1]
    assert df.select(T.parse_jsonl_field(F.col("value"), "ts", fix_log4j=True).alias("c")).collect()[6]["c"] == T0 + 123


def route(spark, rows):
    r = detect_route(lines_of(spark, rows)).first()
    return r["kind"] and (r["kind"], r["arg"]) or r["failure"]


def test_routes(spark):
    iso, sec = "2026-09-27T00:00:00Z a", "1790467200 a"
    assert route(spark, [iso] * 3 + ["  at x"] * 5) == ("log_prefix", "iso8601")
    assert route(spark, [iso, iso, sec, sec]) == "inconsistent"
    assert route(spark, [iso, "x", "y", "z"]) == "no_timestamp"
    assert route(spark, [iso, iso]) == "no_timestamp"
    assert route(spark, ['{"a":1}'] * 4) == "no_time_field"
    assert route(spark, ['{"time":1790467200,"ts":1790467200}'] * 4) == ("jsonl_field", "ts")
    assert route(spark, ['{"time":"2026-09-27T00:00:00Z"}'] * 3) == ("jsonl_field", "time")
