"""Token ids in binary files: tokenise whole texts, write them range-coded (see idcodec), read them back.

Layout of a file: MAGIC; sections of [number of documents, their ids (int64) and null flags, their token counts
(uint32)] each with CRC32 and followed by one superblock of range-coded blocks. A section holds whole documents
up to ``SECTION_IDS`` ids and then at least one, so a longer document has a section of several superblocks of its
own. Files are named by partition; their order and the order within them is ascending document id, nulls first.
A manifest (one row per file) has each file's number of documents and ids.

Each attempt of a task writes a file of its own name, and the manifest lists those of the attempts that ended well, so that a repeated task does no harm.

Edge cases: null text counts as empty, so that such a document has the end id alone; ties in document id keep
all rows; an empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idcodec
from .bpe import read_spec
from .common import array_slices, cache, keep_memory, mapped, shuffle_partitions, work_dir

#: Bytes that end a run: white space that surely separates words for the library too, full stops and commas. Whatever else there is stays within a chunk.
SPACE, STOPS = b" \t\n\r", b".,"
#: 1 for these bytes, 0 for others.
IS_END = bytes(int(c in SPACE + STOPS) for c in range(256))
_IS_SPACE = np.array([c in SPACE for c in range(256)])
_IS_ASCII_LETTER = np.array([bytes([c]).isalpha() for c in range(256)])
#: Second bytes, after C3, of the letters from À to ÿ.
_LATIN, _IS_LATIN = 0xC3, np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])
#: Chunks that a worker remembers, and their bytes at most.
REMEMBERED, REMEMBERED_BYTES = 500_000, 40
#: Words of letters, digits and marks that the normaliser only lower-cases, without what contractions and special tokens begin with.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~]+")
#: What the pre-tokenizer makes of them.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Texts that are cut into chunks together.
TEXT_BYTES = 8 << 20
SECTION_IDS = idcodec.BLOCK * idcodec.LANES
END_ID = 1


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies have for the bytes."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    return dict(zip(shown, map(chr, shown), strict=True)) | {c: chr(256 + k) for k, c in enumerate(sorted(set(range(256)) - set(shown)))}


#: What the vocabulary's file must say of normalisation for words to go to the library's model alone.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": PLAIN_SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks of UTF-8 texts start, each of which ends with white space at the places ``ends``. Runs of white space, full stops and commas are
    cut off from others next to a letter, and where white space is on their side; so that the pre-tokenizer would cut there too. A blank goes with what follows it."""
    kind = np.frombuffer(data.tobytes().translate(IS_END), np.uint8)
    at = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    before, after, opens = data[at - 1], data[at], kind[at] == 0
    second = np.take(data, at + 1, mode="clip")
    latin_after = (after == _LATIN) & _IS_LATIN[second]
    latin_before = (np.take(data, at - 2, mode="clip") == _LATIN) & _IS_LATIN[before]
    fine = np.where(opens, _IS_SPACE[before] | _IS_ASCII_LETTER[after] | latin_after, _IS_SPACE[after] | _IS_ASCII_LETTER[before] | latin_before)
    cut = np.zeros(len(data), bool)
    cut[at[fine] - (opens & (before == SPACE[0]))[fine]] = True
    cut[0] = True
    cut[ends[:-1]] = True
    return np.flatnonzero(cut)


class ChunkTokenizer:
    """The tokenizers library behind a bounded memory of chunks.

    This vocabulary's pre-tokenizer drops white space and never joins what it separates, so that the ids
    of a text are those of its chunks in order. Plain words go to the library's model without its normaliser and pre-tokenizer,
    which only lower-case them and write their bytes as characters.
    """

    def __init__(self, spec: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        told = json.loads(spec)
        normal, split = told["normalizer"] or {}, told["pre_tokenizer"] or {}
        self.plain = normal.get("normalizers") == PLAIN_NORMALIZER and split.get("pretokenizers") == PLAIN_PRE_TOKENIZER
        # such added tokens would be found in words
        self.plain &= not any(PLAIN.fullmatch(t["content"]) for t in told["added_tokens"])
        self.characters = _byte_characters()

    def _learned(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of chunks."""
        others, tokenize, characters = [], self.model.tokenize, self.characters
        for c in chunks:
            bare = c.lstrip(b" ")
            if self.plain and bare.isalpha():  # ASCII letters only
                yield c, array("H", [t.id for t in tokenize(bare.lower().decode())]).tobytes()
                continue
            word = bare.decode()
            if not (self.plain and PLAIN.fullmatch(word)):
                others.append((c, word))
                continue
            pieces = [p if p.isascii() else p.encode().decode("latin-1").translate(characters) for p in PIECE.findall(word.lower())]
            yield c, array("H", [t.id for p in pieces for t in tokenize(p)]).tobytes()
        for (c, _), e in zip(others, self.tokenizer.encode_batch_fast([w for _, w in others], add_special_tokens=False), strict=True):
            yield c, array("H", e.ids).tobytes()

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of all texts (null: empty), each with ``end_id`` after it, and their counts."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        empty, feed = (pa.scalar(x, pa.large_binary()) for x in (b"", b"\n"))
        ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), empty), empty, feed)
        bounds = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, 8 * ended.offset)
        data = np.frombuffer(ended.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        ends = bounds[1:] - bounds[0]
        starts = _starts(data, ends)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        known, different = self.known, coded.dictionary.to_pylist()
        held = list(map(known.get, different))
        missing = [k for k, x in enumerate(held) if x is None]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            learned = dict(self._learned([different[k] for k in part]))
            for k in part:
                c = different[k]
                held[k] = x = learned[c]
                if len(known) < REMEMBERED and len(c) <= REMEMBERED_BYTES:
                    known[c] = x
        sizes = np.fromiter(map(len, held), np.int64, len(held)) >> 1
        codes = np.asarray(coded.indices)
        of_chunk = sizes[codes]
        flat = np.frombuffer(b"".join(held), np.uint16)
        first = np.cumsum(sizes) - sizes
        done = np.cumsum(of_chunk)  # ids up to each chunk's end
        firsts = np.searchsorted(starts, ends)  # the next text's first chunk
        total = done[firsts - 1]
        places = np.repeat(first[codes] - (done - of_chunk), of_chunk)
        places += np.arange(len(places))
        out = np.insert(flat[places], total, np.uint16(end_id))
        return out, np.diff(total, prepend=0) + 1

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """uint16 ids of each text and ``end_id``."""
        flat, counts = self.ids(pa.array(texts, pa.large_string()), end_id)
        data, ends = flat.tobytes(), np.cumsum(counts).tolist()
        return [data[2 * a : 2 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def tokenizer_of(spec: str) -> ChunkTokenizer:
    held, key = cache(__name__), zlib.crc32(spec.encode())
    if key not in held:
        held[key] = ChunkTokenizer(spec)
    return held[key]


def _section(ids: list[int | None], counts: np.ndarray, flat: np.ndarray) -> bytes:
    nulls = np.array([i is None for i in ids], np.uint8)
    head = struct.pack("<I", len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + nulls.tobytes() + counts.astype("<u4").tobytes()
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    for at in range(0, max(1, len(flat)), SECTION_IDS):
        parts.append(idcodec.encode_blocks(flat[at : at + SECTION_IDS]))
    return b"".join(parts)


def sections(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents, token counts and all ids of each section of an open file."""
    if source.read(len(idcodec.MAGIC)) != idcodec.MAGIC:
        raise ValueError("not a file of this format")
    while len(first := source.read(4)) == 4:
        (n,) = struct.unpack("<I", first)
        rest = source.read(n * 13)
        if struct.unpack("<I", source.read(4))[0] != zlib.crc32(first + rest):
            raise ValueError("a section's head is damaged")
        docs = np.frombuffer(rest, "<i8", n)
        nulls = np.frombuffer(rest, np.uint8, n, 8 * n)
        counts = np.frombuffer(rest, "<u4", n, 9 * n).astype(np.int64)
        left, parts = int(counts.sum()), []
        while left > 0 or not parts:
            head = source.read(8)
            _, lanes = idcodec.superblock_size(head)
            word_counts = source.read(4 * lanes)
            more = source.read(idcodec.superblock_bytes(head, word_counts) - 8 - 4 * lanes)
            parts.append(idcodec.decode_blocks(head + word_counts + more))
            left -= len(parts[-1])
        yield [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], counts, np.concatenate(parts)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of rows in order, of TEXT_BYTES together or one longer text. Batches are put together up to there."""
    docs: list[int | None] = []
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        names, done = batch.column(0).to_pylist(), 0
        column = batch.column(1).cast(pa.large_string())
        for part in array_slices(column, TEXT_BYTES):
            more = pc.sum(pc.binary_length(part)).as_py() or 0
            if docs and size + more > TEXT_BYTES:
                yield docs, pa.concat_arrays(held)
                docs, held, size = [], [], 0
            docs += names[done : done + len(part)]
            held.append(part)
            done, size = done + len(part), size + more
    if docs:
        yield docs, pa.concat_arrays(held)


def _sectioned(encoded: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents, ids and counts → documents, counts and ids of each section."""
    ids: list[int | None] = []
    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = 0
    for docs, flat, counts in encoded:
        ends, at, done = np.cumsum(counts), 0, 0
        while at < len(docs):
            to = int(np.searchsorted(ends, done + SECTION_IDS - size, side="right"))  # as many as there is room for
            if to <= at and ids:
                yield ids, np.concatenate(lengths), np.concatenate(held)
                ids, held, lengths, size = [], [], [], 0
                continue
            to = max(to, at + 1)
            end = int(ends[to - 1])
            ids += docs[at:to]
            lengths.append(counts[at:to])
            held.append(flat[done:end])
            size, at, done = size + end - done, to, end
    if ids:
        yield ids, np.concatenate(lengths), np.concatenate(held)


def write_tokens(df: DataFrame, out_dir: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Tokenises and writes; returns the manifest (part, path, n_docs, n_ids). Runs when the manifest is read, so
    read it once: by writing it out."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocab_path))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = docs.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        coder = tokenizer_of(spec.value)
        part, n_docs, n_ids = TaskContext.get().partitionId(), 0, 0
        store, root = pafs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.cmix"
        opened = None
        for docs, counts, flat in _sectioned((docs, *coder.ids(texts, end_id)) for docs, texts in _together(batches)):
            if opened is None:
                opened = store.open_output_stream(f"{root}/{name}")
                opened.write(idcodec.MAGIC)
            opened.write(_section(docs, counts, flat))
            n_docs, n_ids = n_docs + len(docs), n_ids + len(flat)
        if opened is not None:
            opened.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{out_dir}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    return mapped(dealt, run, "part long, path string, n_docs long, n_ids long")


def _read(manifest: DataFrame, schema: str, shaped: Callable) -> DataFrame:
    """Rows of the files: doc_id, start and the columns that ``shaped`` makes of the ids of some documents and their bounds.

    The files' offsets are a running sum over the manifest, which has a row per file and is small by that.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.select("part", "path", "n_ids").collect())
    starts = np.cumsum([0, *(f["n_ids"] for f in files)])
    listed = [(f["path"], int(s)) for f, s in zip(files, starts[:-1], strict=True)]
    schema = f"doc_id long, start long, {schema}"
    if not listed:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame(listed, "path string, base long").repartition(len(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as source:
                    for docs, counts, ids in sections(source):
                        ends = np.concatenate([[0], np.cumsum(counts)])
                        for k in range(0, len(docs), 1000):
                            part = ends[k : k + 1001]
                            columns = {"doc_id": pa.array(docs[k : k + 1000], pa.int64()), "start": pa.array(base + part[:-1])}
                            yield pa.RecordBatch.from_pydict(columns | shaped(ids[part[0] : part[-1]], part - part[0]))
                        base += int(ends[-1])

    return mapped(names, run, schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads files back: doc_id, start (ids of all documents before it), tokens array<int>."""

    def shaped(ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        return {"tokens": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))}

    return _read(manifest, "tokens array<int>", shaped)


def _checksums(ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    flat = ids.astype("<u4")
    sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return {"n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())}


def with_checksum(tokens: DataFrame) -> DataFrame:
    """n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) instead of the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("tokens"))
            found = _checksums(np.asarray(column.values), np.asarray(column.offsets))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "start": batch.column(1)} | found)

    return mapped(tokens.select("doc_id", "start", "tokens"), run, schema)


def read_checksums(manifest: DataFrame) -> DataFrame:
    """``with_checksum`` of ``read_tokens``, told of the ids where they are read, so that these stay in one process."""
    return _read(manifest, "n_tokens long, ids_crc32 long", _checksums)


def round_trip(df: DataFrame, vocab_path: str) -> DataFrame:
    """Writes ``df``'s documents to the shared folder and reads them back."""
    spark = df.sparkSession
    root = work_dir(spark, "tokens")
    write_tokens(df, f"{root}/ids", vocab_path).write.parquet(f"{root}/manifest")
    return read_checksums(spark.read.parquet(f"{root}/manifest"))
