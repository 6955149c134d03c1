"""JSON fields: token pattern, outermost scan, strict parsing, flattening, schema and detection."""

import json
import random

from pyspark.sql import functions as F

from logloom.functions import jsonfields as J
from logloom.functions import strictjson as S
from logloom.operators import sampling

from test_query import lines_of


def one(spark, line, column):
    return spark.createDataFrame([(line,)], "value string").select(column.alias("c")).first()["c"]


def test_extract(spark):
    line = '{"kind":"Return","qty":75,"paid":false,"note":null}'
    v = F.col("value")
    assert [one(spark, line, J.extract_field(v, k)) for k in ("kind", "qty", "paid", "note", "absent")] == ["Return", "75", "false", "null", None]
    assert one(spark, 'before "kind":"sale" after', J.extract_field(v, "kind")) is None
    assert one(spark, '{"p.q":"r"}', J.extract_field(v, "p.q")) == "r"
    assert one(spark, '{"p":"no end', J.extract_field(v, "p")) is None
    assert one(spark, '{"p":,"q":1}', J.extract_field(v, "p")) == ""


def test_scan():
    assert J.scan('{"shop":{"no":9},"paid":true}', "no") is None
    assert J.scan('{ "kind" : "sale" }', "kind") == ("Str", "sale", False)
    assert [J.scan(x, "kind") for x in ('{"kind":"sa', '{"kind":', "", None, '["kind",1]')] == [None] * 5
    assert J.scan('- {"p":"\\"q","kind":-2.75e1}', "kind") == ("Num", "-2.75e1", False)
    assert J.scan('{"p":"\\tq"}', "p") == ("Str", "\\tq", True)
    assert J.scan('["kind":3]', "kind") == ("Num", "3", False)


def test_scan_agrees_with_parsing():
    rng = random.Random(7)
    make = [lambda: None, lambda: rng.random() < 0.5, lambda: rng.randint(-9, 999), lambda: 1.25, lambda: "x", lambda: 'a"b\\', lambda: {"kind": 1}, lambda: [1, "kind"]]
    kinds = {type(None): "Null", bool: "Bool", int: "Num", float: "Num", str: "Str", dict: "Nested", list: "Nested"}
    keys = ["kind", "qty", "shop", "note", "paid"]
    for _ in range(2000):
        value = {k: rng.choice(make)() for k in rng.sample(keys, rng.randint(1, 5))}
        line = json.dumps(value, separators=rng.choice([(",", ":"), (", ", ": ")]))
        for k in keys:
            got = J.scan(line, k)
            assert (got is None) == (k not in value)
            if got:
                assert got[0] == kinds[type(value[k])]
                if got[0] == "Str":
                    assert json.loads(f'"{got[1]}"') == value[k]


def test_strict():
    bad = ['{"a":1} x', "{'a':1}", "[NaN]", "01", '"\\ud800"', "1e999", "", "[" * 128 + "]" * 128, '"a\tb"']
    assert all(S.parse(x) is S.NO_VALUE for x in bad)
    assert S.parse('{"b":1,"a":2,"b":3}') == {"b": 3, "a": 2}
    assert S.compact(S.parse('{"b":1,"a":[1.0,-0,1e16,1e-7,123456789012345680000,0.00001,12.5]}')) == '{"b":1,"a":[1.0,-0.0,1e16,1e-7,1.2345678901234568e20,0.00001,12.5]}'
    assert S.display("x") == "x"


def test_flatten(spark):
    line = '{"kind":"sale","shop":{"no":318,"at":{"city":"oslo"}},"sizes":[3,"m"]}'
    want = [(1, "shop", '{"no":318,"at":{"city":"oslo"}}'), (2, "no", "318"), (2, "at", '{"city":"oslo"}'), (3, "city", "oslo"), (1, "sizes", '[3,"m"]'), (2, "[0]", "3"), (2, "[1]", "m")]
    assert [tuple(r) for r in one(spark, line, J.flatten(F.col("value")))] == want
    assert one(spark, '{"kind":1}', J.flatten(F.col("value"))) == []
    assert one(spark, line, J.is_expandable(F.col("value"))) and not one(spark, "[[]]", J.is_expandable(F.col("value")))
    assert one(spark, line, J.cell(F.col("value"), "sizes", "1")) == "m"
    assert one(spark, line, J.cell(F.col("value"), "sizes", "7")) is None


def test_compact_prefix():
    """As much of the display as the bound has, or nothing; a large value isn't made whole."""
    rng = random.Random(1)

    def made(depth=0):
        return rng.choice([lambda: None, lambda: True, lambda: rng.randint(-9, 99999), lambda: 'é"x' * rng.randint(0, 30), lambda: 1.5, lambda: [made(depth + 1) for _ in range(rng.randint(0, 3 - depth))] if depth < 3 else 1, lambda: {f"k{i}": made(depth + 1) for i in range(rng.randint(0, 3))} if depth < 3 else 2])()

    for _ in range(2000):
        value = made()
        whole = S.compact(value)
        n = len(whole.encode())
        for most in (n - 1, n, n + 1, 256):
            assert most < 0 or S.compact_prefix(value, most) == (whole if n <= most else None)

    class Endless(list):
        def __iter__(self):
            while True:
                yield 1

    assert S.compact_prefix(Endless(), 256) is None and J.value_width(Endless()) == J.WIDEST + 1


def test_detect_and_schema(spark):
    rows = ['{"kind":"Return","remark":"thirty-one characters of remark","discount_of":1}', '{"number":200,"kind":"s"}']
    got = [(r["name"], r["width"]) for r in sampling.discover_schema(lines_of(spark, rows)).orderBy("ord").collect()]
    assert got == [("kind", 6), ("remark", 31), ("discount_of", 11), ("number", 6)]
    many = lines_of(spark, ["{" + ",".join(f'"c{i}":{i}' for i in range(21)) + "}"])
    assert sampling.discover_schema(many).count() == 16
    detect = lambda rows: sampling.detect_jsonl(lines_of(spark, rows)).first()["is_jsonl"]
    assert detect(['{"p":1}'] * 18 + ["plain", "text"]) and not detect(['{"p":1}'] * 17 + ["plain", "text"])
    assert not detect(['{"p":1}'] * 2)
    assert not detect(["[1]"] * 5)
    assert detect(['{"p":1}', "", '{"p":1}', '{"p":1}'])


def test_route_of_mostly_indented_lines(spark):
    """A source whose lines with times are rare: chunk by chunk, up to the first 512 of them."""
    n = 30_000
    lines = spark.range(n).select(F.lit(0).alias("src"), F.col("id").alias("line"), F.when(F.col("id") % 40 == 0, F.concat(F.lit("2024-03-05T06:07:08Z "), F.col("id").cast("string"))).otherwise(F.lit("  indented")).alias("value"))
    sampled = sampling._sampled(lines, ~F.substring("value", 1, 1).isin(" ", "\t"), "src")
    assert sorted(r["line"] for r in sampled.collect()) == [40 * k for k in range(512)]
    assert sampling.detect_route(lines).first()["arg"] == "iso8601"


def test_schema_byte_budget(spark):
    big = json.dumps({"blob": "x" * (1 << 20)})
    rows = [big] * 8 + ['{"late":1}']
    assert [r["name"] for r in sampling.discover_schema(lines_of(spark, rows)).collect()] == ["blob"]
    assert sorted(r["name"] for r in sampling.discover_schema(lines_of(spark, [big] * 3 + ['{"late":1}'])).collect()) == ["blob", "late"]
