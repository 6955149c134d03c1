"""Files as lines: splitting, numbering, encodings, search, offsets and growth."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import access, search
from logloom.sources import lines as L
from logloom.streaming import tail as A

from test_query import hits, lines_of


def values(spark, path, **kw):
    rows = L.open_lines(spark, str(path), **kw).orderBy("line").collect()
    assert [r["line"] for r in rows] == list(range(len(rows)))
    return [r["value"] for r in rows]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"red\r\ngreen\r\n\r\nblue\r\n", ["red", "green", "", "blue"]),
        (b"red\ngreen", ["red", "green"]),
        (b"", []),
        (b"\n", [""]),
        (b"red\n\n", ["red", ""]),
        (b"red\rgreen\r\r\n", ["red\rgreen\r"]),
        (b"\xef\xbb\xbfred\n", ["red"]),
        (b"\xef\xbb\xbf", [""]),  # a mark alone is a line
        (b"\xef\xbb\xbf\n", [""]),
        ("\ufeffRed\ngreen\n".encode("utf-16le"), ["Red", "green"]),
        ("\ufeffRed\r\ngreen".encode("utf-16be"), ["Red", "green"]),
        ("red and green\nblue\n\n".encode("utf-16le"), ["red and green", "blue", ""]),
        ("红 RED\n绿 GREEN\n".encode("gbk"), ["红 RED", "绿 GREEN"]),
    ],
)
def test_open(spark, tmp_path, data, want):
    (tmp_path / "a.log").write_bytes(data)
    assert values(spark, tmp_path / "a.log") == want
    fed = [r["fed"] for r in L.open_lines(spark, str(tmp_path / "a.log")).orderBy("line").collect()]
    ends = data.endswith((b"\n", b"\n\0"))
    assert fed == [True] * (len(want) - 1) + [ends] * bool(want)


@pytest.mark.parametrize("codec", ["utf-16le", "utf-16be"])
def test_utf16_in_stretches(spark, tmp_path, monkeypatch, codec):
    """Stretches that begin in lines, at line feeds and within characters that look like one."""
    rng = random.Random(8)
    want = ["".join(rng.choice("ab\u0a0a\u0a00\u000d中😀") for _ in range(rng.randint(0, 60))) + "x" for _ in range(300)]
    for k, end in enumerate(("", "\n")):
        (tmp_path / f"{k}.log").write_bytes(("\ufeff" + "\n".join(want) + end).encode(codec))
    for stretch, read in ((64, 64), (1000, 26), (1 << 20, 1 << 20)):
        monkeypatch.setattr(L, "STRETCH", stretch)
        monkeypatch.setattr(L, "READ", read)
        rows = L.open_lines(spark, [str(tmp_path / f"{k}.log") for k in range(2)]).collect()
        for k in range(2):
            got = sorted((r["line"], r["raw"], r["fed"]) for r in rows if r["path"].endswith(f"{k}.log"))
            assert got == [(n, v, n < 299 or k == 1) for n, v in enumerate(want)]


def test_large_file(spark, tmp_path):
    """Sparse files of over 2 GiB: only a file's ends are read for what it is, and lines by range."""
    path = tmp_path / "large.log"
    with path.open("wb") as f:
        f.write(b"first line\nsecond")
        f.truncate(3 << 30)
        f.seek(0, os.SEEK_END)
        f.write(b"\n")
    found = L.heads(spark, str(path)).first()
    assert (found["size"], found["encoding"], found["fed"], found["mark_only"]) == ((3 << 30) + 1, "utf-8", True, False)
    wide = tmp_path / "wide.log"
    with wide.open("wb") as f:
        f.write("\ufeffone\ntwo\n".encode("utf-16le"))
        f.truncate((2 << 30) + (64 << 20))
        f.seek(0, os.SEEK_END)
        f.write("\nlast".encode("utf-16le"))
    with L.opened(str(wide)) as f:
        at = (2 << 30) - (128 << 20)
        size = f.size()
        assert [len(x) for part in L._lines16(f, size, at + (128 << 20), size, True) for x in part] == [8]


def test_latin1(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"caf\xe9\n\xff")
    assert values(spark, tmp_path / "a.log") == ["caf\xe9", "\xff"]


def test_numbering_over_splits(spark, tmp_path):
    rng = random.Random(3)
    want = ["x" * rng.randint(0, 199) for _ in range(5000)]
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("\n".join(want[k:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = L.open_lines(spark, [str(tmp_path / f"{k}.log") for k in range(3)])
        for k in range(3):
            got = rows.where(F.endswith("path", F.lit(f"{k}.log"))).orderBy("line").collect()
            assert [(r["line"], r["value"]) for r in got] == list(enumerate(want[k:]))
        found = L.stats(rows, L.heads(spark, str(tmp_path))).orderBy("path").collect()
        assert [(r["lines"], r["encoding"]) for r in found] == [(5000, "utf-8"), (4999, "utf-8"), (4998, "utf-8")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def texts_of(spark, texts):
    """Lines of whole texts, with what follows each."""
    rows = []
    for src, text in enumerate(texts):
        parts = text.split("\n")
        rows += [(src, k, v, v, True) for k, v in enumerate(parts[:-1])] + ([(src, len(parts) - 1, parts[-1], parts[-1], False)] if parts[-1] else [])
    return spark.createDataFrame(rows, "src int, line bigint, value string, raw string, fed boolean")


def test_search(spark):
    df = texts_of(spark, ["WARN p\nok q WARN WARN\nok\nWARN r\n"])
    assert hits(search.search_lines(df, "WARN", cap=100)) == [0, 1, 3] and hits(search.search_lines(df, "WARN", cap=2)) == [0, 1]
    assert search.search_total(df, "WARN").first()["total"] == 4
    assert not search.by_line(r"ok\s+WARN") and search.by_line("W[A-Z]+ [qr]")
    assert hits(search.search_lines(df, r"ok\s+WARN")) == [2]
    assert hits(search.search_lines(df, "^WARN")) == [0] and hits(search.search_lines(df, "(?m)^WARN")) == [0, 3]
    for pattern in ("a(?=b)", r"(a)\1", "a++", "(?>a)"):
        with pytest.raises(ValueError, match="aren't supported"):
            search.check(pattern)
    search.check(r"\p{L}+ \x{41}+ [+]+")


def test_search_true_text(spark):
    """Line feeds as the text has them, the text's end, and Unicode classes, by every path."""
    for text, pattern, want in [
        ("x\nx\n", r"x\n", 2),
        ("x\nx", r"x\n", 1),
        ("x\nx\n", r"x\n\z", 1),
        ("x\nx\n", "x$", 0),  # the end is after the line feed
        ("x\nx", "x$", 1),
        ("x\nx\n", "(?m)x$", 2),
        ("Ärger über\nÖl x", r"\p{L}+ über", 1),
        ("Ärger\nÖl x", r"\p{Lu}\p{Ll}+\n\p{Lu}", 1),
        ("a\u00a0b", r"a\sb", 1),
        ("a\u001cb", r"a\sb", 0),
        ("AB", r"\x{41}B", 1),
        ("x7y", r"[\w&&[^\d]]", 2),
        ("aab", "a*", 2),  # none right after a match
        ("]a", r"[]a]+", 1),
    ]:
        total = search.search_total(texts_of(spark, [text]), pattern).first()
        assert (total["total"] if total else 0) == want, (text, pattern)


def test_search_in_stretches(spark, monkeypatch):
    """Matches that reach from one stretch into the next, and chains of them, against the text as a whole."""
    import regex

    rng = random.Random(2)
    monkeypatch.setattr(search, "STRETCH_LINES", 8)
    texts = ["".join(rng.choice("ab\n\n") for _ in range(400)), "a\n" * 100 + "a", "ab\n" * 50, "", "x"]
    df = texts_of(spark, texts)
    for pattern in (r"a\na", r"\n", r"[ab]\n\n?[ab]", r"\n{3}", r"b\n|\na"):
        assert search._width(pattern)[1] is not None
        got = {(r["src"], r["line"]): r["matches"] for r in search.match_counts(df, pattern).collect()}
        want = {}
        for src, text in enumerate(texts):
            for m in regex.finditer(pattern, text):
                at = src, text.count("\n", 0, m.start())
                want[at] = want.get(at, 0) + 1
        assert got == want, pattern


def test_progress_and_cancellation(spark):
    from logloom.sources.progress import Cancelled, followed

    told = []
    assert followed(spark, lambda: spark.range(0, 1000, 1, 4).repartition(4).count(), lambda done, known: told.append((done, known))) == 1000
    assert told and all(0 <= done <= known for done, known in told)
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda batches: (b for b in batches if not __import__("time").sleep(30)), "id long")
    with pytest.raises(Cancelled):
        followed(spark, slow.count, cancelled=lambda: True)
    with pytest.raises(ZeroDivisionError):
        followed(spark, lambda: 1 // 0)


def test_offsets(spark):
    df = lines_of(spark, ["ab", "", "cdeé"])
    asked = spark.createDataFrame([(0, k) for k in range(12)], "src int, offset bigint")
    got = {r["offset"]: r["line"] for r in access.offset_to_line(df, asked).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2, 9: 2}


def test_stat(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"red")
    stat = A.FileStat.of(str(path))
    assert not A.is_stale(stat, str(path)) and not A.is_stale(stat, f"file:{path}")
    path.write_bytes(b"reds")
    assert A.is_stale(stat, str(path))
    os.remove(path)
    assert A.is_stale(stat, str(path))
    assert A.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_growing(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"\xef\xbb\xbfhalf ")
    file = A.Growing(str(path))
    assert file.poll() == ("appended", 0, [b"half "])
    assert file.poll() == (None, 1, [])
    with path.open("ab") as f:
        f.write(b"a line\r\nand one\n")
    kind, first, lines = file.poll()
    assert (kind, first) == ("appended", 0) and lines[0].endswith(b"half a line") and lines[1:] == [b"and one"]
    with path.open("ab") as f:
        f.write(b"two\n")
    assert file.poll() == ("appended", 2, [b"two"])
    path.write_bytes(b"new\n")
    assert file.poll() == ("rebuilt", 0, [b"new"])
    path.write_bytes(b"another one\nand longer\n")
    assert file.poll() == ("rebuilt", 0, [b"another one", b"and longer"])
    state = file.at
    assert file.rebuild() and file.at.same_content(state)
    os.remove(path)
    state = file.at
    assert not file.rebuild() and file.at == state and file.poll() == (None, 2, [])


def test_growing_encodings(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes("红\n绿".encode("gbk"))
    file = A.Growing(str(path))
    assert file.poll() == ("appended", 0, ["红".encode("gbk"), "绿".encode("gbk")]) and file.at.encoding == "gbk"
    with path.open("ab") as f:
        f.write("色\n".encode("gbk"))
    assert file.poll() == ("appended", 1, ["绿色".encode("gbk")])
    wide = tmp_path / "b.log"
    wide.write_bytes("\ufeffred\ngr".encode("utf-16le"))
    file = A.Growing(str(wide))
    assert file.poll() == ("appended", 0, [x.encode("utf-16le") for x in ("red", "gr")])
    with wide.open("ab") as f:
        f.write("een\r\n".encode("utf-16le"))
    assert file.poll() == ("rebuilt", 0, [x.encode("utf-16le") for x in ("red", "green")])
    plain = tmp_path / "c.log"
    plain.write_bytes(b"ascii so far\n")
    file = A.Growing(str(plain))
    file.poll()
    with plain.open("ab") as f:
        f.write(b"caf\xe9\n")  # tells another encoding
    assert file.poll() == ("rebuilt", 0, [b"ascii so far", b"caf\xe9"]) and file.at.encoding == "latin-1"


def follow(spark, paths, root):
    q = A.tail(spark, [str(p) for p in paths]).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(A.SCHEMA).parquet(f"{root}/out")


def test_streaming_goes_on_after_restarts(spark, tmp_path):
    """Nothing is given again after a restart, whether the files have changed or not; rebuilt files and other encodings are told."""
    path, gbk, wide = (tmp_path / n for n in ("a.log", "b.log", "c.log"))
    path.write_bytes(b"red\ngre")
    gbk.write_bytes("红\n".encode("gbk"))
    wide.write_bytes("\ufeffred\n".encode("utf-16le"))
    paths = [path, gbk, wide, tmp_path / "not there"]
    now = lambda rows, p: [(r["line"], r["value"]) for r in A.latest(rows).where(F.endswith("path", F.lit(p.name))).orderBy("line").collect()]
    rows = follow(spark, paths, tmp_path)
    assert rows.count() == 4
    assert follow(spark, paths, tmp_path).count() == 4  # a restart with nothing new
    with path.open("ab") as f:
        f.write(b"en\nblue\n")
    with gbk.open("ab") as f:
        f.write("绿\n".encode("gbk"))
    rows = follow(spark, paths, tmp_path)
    assert rows.count() == 7 and now(rows, path) == [(0, "red"), (1, "green"), (2, "blue")] and now(rows, gbk) == [(0, "红"), (1, "绿")]
    path.write_bytes(b"one\n")
    with wide.open("ab") as f:
        f.write("grün\n".encode("utf-16le"))
    rows = follow(spark, paths, tmp_path)
    assert now(rows, path) == [(0, "one")] and now(rows, wide) == [(0, "red"), (1, "grün")]
    assert follow(spark, paths, tmp_path).count() == rows.count()


def test_stretches_of_a_batch(tmp_path, monkeypatch):
    """Large growth is read by several tasks, which begin at lines and know their numbers."""
    monkeypatch.setattr(A, "SPLIT_BYTES", 3 << 20)
    path = tmp_path / "a.log"
    want = [f"line {k} " + "x" * (k % 90) for k in range(200_000)]
    path.write_text("\n".join(want))
    reader = A.TailReader([str(path)])
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) >= 3
    got = [row for p in parts for row in reader.read(p)]
    assert [(r[1], r[2]) for r in got] == list(enumerate(want))


def test_filter_on_a_stream(spark, tmp_path):
    from logloom.operators.filters import run_filter

    path = tmp_path / "a.jsonl"
    path.write_text('{"level":"ERROR"}\n{"level":"INFO"}\n')
    found = run_filter(A.tail(spark, [str(path)]), "level=error", by="path")
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        with path.open("a") as f:
            f.write('{"level":"Error"}\n')
        q.processAllAvailable()
        assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2]
    finally:
        q.stop()


def test_export_and_rate(spark, tmp_path):
    data = b"a\r\nb\xff\n\n"
    (tmp_path / "a.log").write_bytes(data)
    assert b"".join(bytes(r["content"]) for r in L.export_bytes(spark, str(tmp_path / "a.log"), 3).orderBy("start").collect()) == data
    assert L.mib_per_second(1 << 20, 2) == 0.5 and L.mib_per_second(1, 0) == float("inf")
    assert L.empty(spark).count() == 0
