"""WARC archives with a two-level capture index.

Records are written as gzip members of their own, so that any record can be read by its range. The index has a line for every
record, keyed by the URL with its host reversed and the page id, in key order. Lines are packed in compressed blocks of
``BLOCK_LINES``; a sparse directory keeps the first key and place of each block. A look-up deals its keys by the ranges of the index files, of which there are
as many as shuffle partitions, whatever the size of the data. Each range's part of the directory is searched by bisection for the
blocks that may hold a key; these are read and bisected, and then the records are read by range. Ranges that
follow each other closely in a file are read in one request.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest page id is the response; the others are
revisits that refer to it. Smaller ones are all responses.

Edge cases: null html is an empty payload, a null URL an empty key. Rows without a page id are written and returned,
and are the response only if no equal payload has an id. Rows repeated with one page id are captures of their own: all of those with the largest id
are responses. Very long payloads are records like others. An empty table gives no files and no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, work_dir, written

BLOCK_LINES = 1000
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
#: Records in the same file that lie this close together are read in one request, up to READ_MOST bytes.
GAP, READ_MOST = 64 << 10, 8 << 20
#: Keys that search a part of the directory together; more are dealt over several tasks with a copy of the part each.
KEYS_MOST = 200_000
#: Up to this number of payloads that occur twice, 30 bytes each, they are broadcast; more are joined.
BROADCAST_PAYLOADS = 400_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, comma-joined, then `)` and the rest; in lower case up to the path."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sort_key(url: str | None, page: int | None) -> str:
    """Key of a capture: ids in 20 digits keep their order as text; no id comes first."""
    number = "" if page is None else f"{page + (1 << 63):020d}"
    return f"{url_key(url)} {number}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page: int | None, payload: bytes, refers_to: int | None, response: bool) -> bytes:
    """One record of an HTTP exchange. A revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Target-URI: {(url or '').encode('ascii', 'backslashreplace').decode().replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload (None for revisits), payload_bytes, payload_digest, record_type and refers_to of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a record's payload doesn't match its digest")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def with_refers(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set for revisits. Only payloads that occur twice are joined; they are a table of their own, so
    that the pages of a frequent one can be split over tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = F.octet_length("html") >= revisit_from
    twice = rows.where(large).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where(F.col("n") > 1).select(F.col("sha").alias("dup_sha"), "keeper")
    twice = written(twice, "payloads")
    if twice.count() <= BROADCAST_PAYLOADS:
        twice = F.broadcast(twice)
    joined = rows.join(twice, (F.col("sha") == F.col("dup_sha")) & large, "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, out_dir: str, revisit_from: int = 0) -> DataFrame:
    """Writes one archive per partition; returns the index lines (key, url, page_id, file, at, size) when read. Read it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("key", "page_id", "file", "at", "size")}
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200).to_pydict()
                for page, url, html, refers in zip(part["page_id"], part["url"], part["html"], part["refers_to"], strict=True):
                    packer = zlib.compressobj(LEVEL, wbits=31)
                    data = packer.compress(record(url, page, html.encode(), refers, refers is None)) + packer.flush()
                    if out is None:
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    for c, v in zip(rows, (sort_key(url, page), page, name, at, len(data)), strict=True):
                        rows[c].append(v)
                    at += len(data)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
        if out is not None:
            out.close()

    return mapped(with_refers(pages, revisit_from), run, "key string, page_id long, file string, at long, size long")


def write_index(lines: DataFrame, out_dir: str) -> DataFrame:
    """Sorts the lines over all tasks and packs them; returns the directory (first, last, file, at, size, lines). Read it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx.gz"
        out, at, held = None, 0, []

        def packed() -> pa.RecordBatch:
            nonlocal out, at, held
            packer = zlib.compressobj(6, wbits=31)
            data = packer.compress("\n".join(json.dumps(x) for x in held).encode()) + packer.flush()
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            row = {"first": [held[0][0]], "last": [held[-1][0]], "file": [name], "at": [at], "size": [len(data)], "lines": [len(held)]}
            at, held = at + len(data), []
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for line in zip(*batch.to_pydict().values(), strict=True):
                held.append(line)
                if len(held) == BLOCK_LINES:
                    yield packed()
        if held:
            yield packed()
        if out is not None:
            out.close()

    dealt = lines.select("key", "file", "at", "size").repartitionByRange(shuffle_partitions(lines.sparkSession), "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return mapped(dealt, run, "first string, last string, file string, at long, size long, lines long")


def _blocks_of(first: list[str], last: list[str], key: str) -> range:
    """The blocks (or files) that may hold ``key``: by bisection over first and last keys in order."""
    return range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))


def _placed(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """(key, file, at, size) of the blocks that may hold each distinct key: by bisection of the files' ranges, then of a file's directory."""
    spark = keys.sparkSession
    # a row for each index file, and so for each shuffle partition at most
    ranges = sorted((r["low"], r["high"], r["file"]) for r in directory.groupBy("file").agg(F.min("first").alias("low"), F.max("last").alias("high")).collect())
    sent = spark.sparkContext.broadcast(tuple(zip(*ranges, strict=True)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, files = sent.value
        for batch in batches:
            found = [(key, files[k]) for key in batch.column(0).to_pylist() for k in _blocks_of(low, high, key)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.string()), "file": pa.array([f for _, f in found], pa.string())})

    dealt = written(mapped(keys.where(F.col("key").isNotNull()).select("key").distinct(), deal, "key string, file string"), "keys")
    shares = dealt.groupBy("file").agg(F.ceil(F.count("*") / KEYS_MOST).cast("int").alias("shares"))
    # a row for each file, as above
    asked = dealt.join(F.broadcast(shares), "file").select("file", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("asked"), F.col("key").alias("first"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("size"))
    known = directory.join(F.broadcast(shares), "file").select("file", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("asked"), "first", "last", "at", "size")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, places = None, [], [], []
        for batch in batches:
            out: list[tuple] = []
            for file, share, asking, key, end, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (file, share):
                    now, first, last, places = (file, share), [], [], []
                if asking:
                    out += [(key, file, *places[k]) for k in _blocks_of(first, last, key)]
                else:
                    first.append(key)
                    last.append(end)
                    places.append((at, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "at", "size"])

    met = asked.unionByName(known).repartition(shuffle_partitions(spark), "file", "share").sortWithinPartitions("file", "share", "asked", "first", "last", "at")
    return mapped(met, place, "key string, file string, at long, size long")


def find(keys: DataFrame, directory: DataFrame, index_dir: str) -> DataFrame:
    """(key, file, at, size) of every capture of each distinct ``key``: directory, block, line."""
    spark = keys.sparkSession
    schema = "key string, file string, at long, size long"
    if directory.isEmpty():
        return spark.createDataFrame([], schema)
    placed = _placed(keys, directory)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(index_dir)
        now, lines, names = None, [], []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if now != (row["file"], row["at"]):
                    now = row["file"], row["at"]
                    with store.open_input_file(f"{root}/{row['file']}") as source:
                        packed = source.read_at(row["size"], row["at"])
                    lines = [json.loads(x) for x in zlib.decompress(packed, wbits=31).decode().split("\n")]
                    names = [x[0] for x in lines]
                for k in range(bisect.bisect_left(names, row["key"]), bisect.bisect_right(names, row["key"])):
                    out.append(dict(zip(("key", "file", "at", "size"), lines[k], strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    n = shuffle_partitions(spark)
    return mapped(placed.repartition(n, "file", "at").sortWithinPartitions("file", "at", "key"), search, schema)


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(found: DataFrame, archive_dir: str, with_payload: bool = True) -> DataFrame:
    """Reads records by range and checks them. Captures are dealt by file and stretches of it, and read in order of place."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(archive_dir)
        name, source = None, None
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            k = 0
            while k < len(rows):
                file, begin, size = rows[k]
                end, last = begin + size, k + 1
                while last < len(rows) and rows[last][0] == file and rows[last][1] - end <= GAP and rows[last][1] + rows[last][2] - begin <= READ_MOST:
                    end, last = max(end, rows[last][1] + rows[last][2]), last + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                data = memoryview(source.read_at(end - begin, begin))
                got = [parse(zlib.decompress(data[at - begin : at - begin + n], wbits=31)) for _, at, n in rows[k:last]]
                yield pa.RecordBatch.from_pydict({c: [r[c] for r in got] for c in kind.names}, schema=kind)
                k = last
        if source is not None:
            source.close()

    dealt = found.select("file", "at", "size").repartition(shuffle_partitions(found.sparkSession), "file", F.floor(F.col("at") / (4 * READ_MOST)))
    return mapped(dealt.sortWithinPartitions("file", "at"), run, CAPTURE if with_payload else CAPTURE.rpartition(", ")[0])


class Archive:
    """Archives and their index below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def written(cls, pages: DataFrame, root: str, revisit_from: int = 0) -> Archive:
        spark = pages.sparkSession
        write_archives(pages, f"{root}/archives", revisit_from).write.parquet(f"{root}/lines")
        write_index(spark.read.parquet(f"{root}/lines"), f"{root}/index").write.parquet(f"{root}/directory")
        return cls(spark, root)

    def look_up(self, keys: DataFrame, with_payload: bool = True) -> DataFrame:
        """The captures of the keys (column key; see sort_key)."""
        found = find(keys, self.spark.read.parquet(f"{self.root}/directory"), f"{self.root}/index")
        return read_records(found, f"{self.root}/archives", with_payload)


def keys_of(pages: DataFrame) -> DataFrame:
    """Capture keys (column key) of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sort_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string())})

    return mapped(pages.select(F.col("url").cast("string"), F.col("page_id").cast("long")), run, "key string")


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes pages as archives and reads every capture back through the index."""
    archive = Archive.written(pages, work_dir(pages.sparkSession, "warc"), revisit_from)
    return archive.look_up(keys_of(pages), with_payload=False)
