"""Files that grow: what changed since a snapshot, and a streaming source of their lines.

The last line of a file may not be finished. It is given at once, and again, with the same number and a higher version, when it has
grown; a reader keeps the highest version of each line. A snapshot follows from the file alone, so that a stream goes on after a restart where it was. UTF-8, GBK and Latin-1 files are read on from
where they ended; UTF-16 files, and files whose beginning tells another encoding than before, are built anew, as are those that have been replaced or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.lines import HEAD_BYTES, MARK, UTF8, UTF16BE, UTF16LE, _lines16, detect_encoding, opened

HEAD = 64
#: Fixed values of the FNV-1a hash of 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SCHEMA = "path string, line bigint, value string, version bigint, change_kind string"
APPENDED, REBUILT = "appended", "rebuilt"
#: Bytes of new lines that one task reads, about.
SPLIT_BYTES = 64 << 20


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def _looked_up(path: str) -> tuple[int, int]:
    """Size and time of change; OSError if there is no such file."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        store, at = pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    else:
        store, at = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    found = store.get_file_info(at)
    if found.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return found.size, found.mtime_ns or 0


@dataclass(frozen=True)
class FileStat:
    """Identity of a file's state: size, time of change and a hash of its first 64 bytes."""

    size: int
    mtime_ns: int
    head: int

    @classmethod
    def of(cls, path: str) -> FileStat:
        size, mtime = _looked_up(path)
        with opened(path) as f:
            return cls(size, mtime, fnv1a(f.read_at(min(HEAD, size), 0)))


def is_stale(stat: FileStat, path: str) -> bool:
    """Whether anything differs, or the file can't be read."""
    try:
        return FileStat.of(path) != stat
    except OSError:
        return True


@dataclass(frozen=True)
class Snapshot:
    """How far a file has been read: its bytes, its lines, where its last line begins if that isn't finished (else -1), a hash of its first
    bytes and how many those were, its encoding, and a version, which grows with time."""

    size: int = 0
    lines: int = 0
    open_at: int = -1
    head: int = FNV_OFFSET
    head_size: int = 0
    encoding: str = UTF8
    version: int = 0

    def same_content(self, other: Snapshot) -> bool:
        return replace(self, version=0) == replace(other, version=0)


def _encoding(f: pa.NativeFile, size: int) -> str:
    return detect_encoding(f.read_at(min(HEAD_BYTES, size), 0), size <= HEAD_BYTES)


def change(old: Snapshot, path: str) -> str | None:
    """APPENDED if the file has grown and still begins as before, REBUILT if it is another or a shorter one, or in UTF-16, or its encoding is told otherwise
    now; None without change in size."""
    size, _ = _looked_up(path)
    with opened(path) as f:
        same = size >= old.size and fnv1a(f.read_at(old.head_size, 0)) == old.head
        if not same:
            return REBUILT
        if size == old.size:
            return None
        encoding = _encoding(f, size)
    return REBUILT if old.size and (encoding != old.encoding or encoding in (UTF16LE, UTF16BE)) else APPENDED


def read_lines(path: str, start: int, end: int, encoding: str = UTF8) -> Iterator[bytes]:
    """The lines of bytes ``start`` to ``end``, without line feeds and one carriage return each."""
    with opened(path) as f:
        if encoding in (UTF16LE, UTF16BE):
            cr = "\r".encode(encoding)
            for found in _lines16(f, end, start, end, encoding == UTF16LE):
                yield from (line.removesuffix(cr) for line in found)
            return
        at, held = start, []
        while at < end:
            data = f.read_at(min(1 << 20, end - at), at)
            if not data:
                break
            at += len(data)
            first, *rest = data.split(b"\n")
            held.append(first)
            for line in rest:
                yield b"".join(held).removesuffix(b"\r")
                held = [line]
        if last := b"".join(held):
            yield last.removesuffix(b"\r")


def advanced(old: Snapshot, path: str) -> tuple[Snapshot, list[tuple[int, int]]]:
    """The snapshot of the file as it is, from an ``old`` one that it continues, and the places (byte, line) at which stretches of SPLIT_BYTES may begin.
    Line feeds are counted once, and nothing is kept."""
    size, mtime = _looked_up(path)
    started, marks = old.lines - (old.open_at >= 0), []
    with opened(path) as f:
        head = f.read_at(min(HEAD, size), 0)
        encoding = _encoding(f, size)
        version = max(mtime, old.version + 1)
        if encoding in (UTF16LE, UTF16BE):
            lines = sum(map(len, _lines16(f, size, 0, size, encoding == UTF16LE)))
            return Snapshot(size, lines, -1, fnv1a(head), len(head), encoding, version), []
        at, feeds, last = old.size, 0, old.open_at if old.open_at >= 0 else old.size
        mark = last
        while at < size and (data := f.read_at(min(1 << 20, size - at), at)):
            if n := data.count(b"\n"):
                feeds += n
                last = at + data.rindex(b"\n") + 1
                if last - mark >= SPLIT_BYTES:
                    mark = last
                    marks.append((last, started + feeds))
            at += len(data)
    unfinished = last < size
    return Snapshot(size, started + feeds + unfinished, last if unfinished else -1, fnv1a(head), len(head), encoding, version), [m for m in marks if m[0] < size]


class Growing:
    """A file followed by one process: each call of ``poll`` gives (change, first line, new lines). What can't be read leaves the state as it was."""

    def __init__(self, path: str):
        self.path, self.at = path, Snapshot()

    def poll(self) -> tuple[str | None, int, list[bytes]]:
        try:
            kind = change(self.at, self.path)
            return (None, self.at.lines, []) if kind is None else self._read(kind)
        except OSError:
            return None, self.at.lines, []

    def rebuild(self) -> bool:
        """Reads the file anew; False, with the old state, if that fails."""
        try:
            self._read(REBUILT)
        except OSError:
            return False
        return True

    def _read(self, kind: str) -> tuple[str, int, list[bytes]]:
        old = Snapshot(version=self.at.version) if kind == REBUILT else self.at
        new, _ = advanced(old, self.path)
        first = old.lines - (old.open_at >= 0)
        lines = list(read_lines(self.path, old.open_at if old.open_at >= 0 else old.size, new.size, new.encoding))
        mark = "\ufeff".encode(new.encoding) if new.encoding in (UTF16LE, UTF16BE) else MARK
        if first == 0 and lines:
            lines[0] = lines[0].removeprefix(mark)
        self.at = new
        return kind, first, lines


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, line: int, encoding: str, version: int, kind: str):
        super().__init__(None)
        self.path, self.start, self.end, self.line, self.encoding, self.version, self.kind = path, start, end, line, encoding, version, kind


class TailReader(DataSourceStreamReader):
    """Offsets are snapshots by path. A batch is what lies between two of them, in stretches of SPLIT_BYTES that begin at lines. New bytes are counted once by the
    driver, which keeps nothing of them; after a restart, the files are counted once from their beginning."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.held: dict[str, Snapshot] = {}
        self.marks: dict[str, list[tuple[int, int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in self.paths:
            old = self.held.get(path, Snapshot())
            try:
                kind = change(old, path)
                if kind is None:
                    continue
                begin = Snapshot(version=old.version) if kind == REBUILT else old
                self.held[path], marks = advanced(begin, path)
            except OSError:  # gone, or not readable now: the old state stays
                continue
            self.marks[path] = ([] if kind == REBUILT else self.marks.get(path, [])) + marks
        return {p: asdict(s) for p, s in sorted(self.held.items())}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, state in sorted(end.items()):
            new, old = Snapshot(**state), Snapshot(**start.get(path, {}))
            if new.same_content(old):
                continue
            whole = new.encoding in (UTF16LE, UTF16BE)
            grown = new.size >= old.size and (not old.size or new.encoding == old.encoding and not whole) and self._same_head(path, old)
            kind = APPENDED if grown else REBUILT
            if not grown:
                old = Snapshot()
            at, line = old.open_at if old.open_at >= 0 else old.size, old.lines - (old.open_at >= 0)
            for place, number in [] if whole else sorted(self.marks.get(path, [])):
                if at < place < new.size:
                    out.append(Stretch(path, at, place, line, new.encoding, new.version, kind))
                    at, line = place, number
            if at < new.size:
                out.append(Stretch(path, at, new.size, line, new.encoding, new.version, kind))
        return out

    @staticmethod
    def _same_head(path: str, old: Snapshot) -> bool:
        with opened(path) as f:
            return fnv1a(f.read_at(old.head_size, 0)) == old.head

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for k, line in enumerate(read_lines(partition.path, partition.start, partition.end, partition.encoding)):
            text = line.decode(partition.encoding, "replace")
            if partition.start == 0 and k == 0:
                text = text.removeprefix("\ufeff")
            yield partition.path, partition.line + k, text, partition.version, partition.kind

    def commit(self, end: dict) -> None:
        for path, state in end.items():
            self.marks[path] = [m for m in self.marks.get(path, []) if m[0] > state["size"]]


class TailSource(DataSource):
    """``spark.readStream.format("logtail").option("paths", "a.log;b.log")``."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader([p for p in self.options["paths"].split(";") if p])


def tail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A streaming table of the files' lines as they grow. Files must be visible to driver and executors by the same path."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("logtail").option("paths", ";".join(paths)).load()


def latest(changes: DataFrame) -> DataFrame:
    """(path, line, value) as the files are now: the highest version of each line since the file was last built anew."""
    built = changes.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("change_kind") == REBUILT, F.col("version"))), F.lit(0)).alias("_built"))
    own = changes.join(built, "path").where(F.col("version") >= F.col("_built"))
    return own.groupBy("path", "line").agg(F.max_by("value", "version").alias("value"))
