"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["src", "line"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_against_sql(spark):
    import duckdb

    from logloom import registry

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "events"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registry.ORACLES.items():
        got = registry.QUERIES[name](spark, sf)
        want = db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        a = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
        b = sorted(want.select(*(f'"{c}"' for c in columns)).fetchall(), key=repr)
        assert a == b, name
