"""Ops 1 and 5: ids against the tokenizers library, files and decoding as round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe, idcodec, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "a  b   c\n\n d\t\te", "it's 'tis we'll  DON'T", "hello<|endoftext|>world <|endoftext|>", "\x1c a\x1d\x1f b", "日本語 😀 ñandú", "x" * 3000 + "ab" * 500, "a　 b\x85c", "é ... ,, a.b,c. ", "ſ İ K ﬁ", "<|startoftext|> <|endoftext|>x"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdehtiosn  \n'12.,éß<|\x1e İ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_library():
    own, library = bpe.SpeculativeBPE(bpe.read_spec(BYTE)), Tokenizer.from_file(BYTE)
    texts = TRICKY + random_texts(3000)
    for part in (texts, texts):  # once learned, once remembered
        got = [np.frombuffer(x, np.int32).tolist() for x in own.encode(part)]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert got == want
        assert [own.decode(np.array(x, np.int32)) for x in got] == library.decode_batch(want, skip_special_tokens=False)


def test_bpe_memory_full(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own, library = bpe.SpeculativeBPE(bpe.read_spec(BYTE)), Tokenizer.from_file(BYTE)
    for text in random_texts(50, 2):
        assert np.frombuffer(own.encode([text])[0], np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_token_is_verified():
    own = bpe.SpeculativeBPE(bpe.read_spec(BYTE))
    library = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, own.size - 1, (2, 4000))
    fine = own.compatible(a, b)
    words = [own.piece[x] + own.piece[y] for x, y in zip(a, b)]
    for x, y, ok, word in zip(a, b, fine, words):
        assert bool(ok) == (own._merged(word) == [x, y]) or not (own.buildable[x] and own.buildable[y])
    assert library.get_vocab_size() == own.size


def test_word_ids_equal_library():
    own, library = tokens.ChunkTokenizer(bpe.read_spec(WORD)), Tokenizer.from_file(WORD)
    texts = TRICKY + random_texts(2000, 3)
    got = [np.frombuffer(x, np.uint16).tolist() for x in own.encode(texts, 1)]
    assert got == [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 4))
def test_codec_round_trip(ids, repeat):
    x = np.array(ids * repeat, np.int64)
    assert (idcodec.decode_blocks(idcodec.encode_blocks(x)) == x).all()


@pytest.mark.parametrize("n", [idcodec.BLOCK - 1, idcodec.BLOCK, idcodec.BLOCK + 1, 3 * idcodec.BLOCK + 7])
def test_codec_blocks(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.3, n), 49407)
    packed = idcodec.encode_blocks(x)
    assert (idcodec.decode_blocks(packed) == x).all()
    assert len(packed) < 2 * n
    damaged = bytearray(packed)
    damaged[len(packed) // 2] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        idcodec.decode_blocks(bytes(damaged))


def test_word_ids_of_marked_words():
    """Blanks, stops, marks, digits and accents next to letters; combining marks, contractions and special tokens next to stops."""
    own, library = tokens.ChunkTokenizer(bpe.read_spec(WORD)), Tokenizer.from_file(WORD)
    assert own.plain
    rng = random.Random(5)
    parts = ["thanea", "Éa", "ÀÖ", "ß", "ñ×", "÷a", "T", "\u0308", "\u0338", ".", ",", "..", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "<|", "<", "7", "42", "&&&", "#", "K", "İ", "日", "\x1f", "\u00a0", "é", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for _ in range(2):  # once learned, once remembered
        got = [np.frombuffer(x, np.uint16).tolist() for x in own.encode([*texts, None], 1)]
        assert got == [e.ids + [1] for e in library.encode_batch([*texts, ""], add_special_tokens=False)]


def test_library_gets_words_alone(monkeypatch):
    """The whole way through the library, some 15 microseconds a word, is for chunks that aren't plain; repeated ones go nowhere."""
    own, seen = tokens.ChunkTokenizer(bpe.read_spec(WORD)), []

    class Library:
        def encode_batch_fast(self, chunks, add_special_tokens):
            seen.extend(chunks)
            return library.encode_batch_fast(chunks, add_special_tokens=add_special_tokens)

    library, own.tokenizer = own.tokenizer, Library()
    texts = ["The thanea, Éanß won&&& 12. It's\nThe end."] * 3
    assert len({*own.encode(texts, 1)}) == 1
    assert all("'" in c or not c.strip(" \t\n\r.,") for c in seen) and len(seen) == len(set(seen))


def test_memory_of_chunks_full(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own, library = tokens.ChunkTokenizer(bpe.read_spec(WORD)), Tokenizer.from_file(WORD)
    for text in [*random_texts(50, 4), "y" * 100]:
        assert np.frombuffer(own.encode([text], 1)[0], np.uint16).tolist() == library.encode(text, add_special_tokens=False).ids + [1]
        assert len(own.known) <= 3


def test_codec_repeats_and_uneven_blocks():
    """Blocks of repeats, of one id and of noise side by side: few or no ids by order 0 in some."""
    rng = np.random.default_rng(1)
    noise, again = rng.integers(0, 65536, idcodec.BLOCK), np.tile(rng.integers(0, 49407, 50), idcodec.BLOCK // 50 + 1)[: idcodec.BLOCK]
    x = np.concatenate([noise, again, np.full(idcodec.BLOCK, 65535), np.zeros(idcodec.BLOCK, int), noise[::-1], again[:7]])
    packed = idcodec.encode_blocks(x)
    assert (idcodec.decode_blocks(packed) == x).all()
    assert len(idcodec.encode_blocks(again)) < 0.1 * len(idcodec.encode_blocks(noise))
    for place in rng.integers(8 + 8 * 6, len(packed), 20):
        damaged = bytearray(packed)
        damaged[place] ^= 1 + int(rng.integers(255))
        try:  # a flush's last bits may be free; whatever is read is right or told
            assert (idcodec.decode_blocks(bytes(damaged)) == x).all()
        except ValueError as e:
            assert "damaged" in str(e)


def test_sections_hold_whole_documents(spark, monkeypatch):
    """Rows of many batches, some longer than a section, in order."""
    monkeypatch.setattr(tokens, "SECTION_IDS", 64)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 500)
    rng = np.random.default_rng(2)
    counts = [rng.choice([1, 1, 5, 63, 64, 65, 300], n) for n in (1, 40, 7)]
    parts = [(list(range(100 * k, 100 * k + len(c))), rng.integers(0, 9, c.sum()), c) for k, c in enumerate(counts)]
    found = list(tokens._sectioned(iter(parts)))
    assert [d for ids, _, _ in found for d in ids] == [d for ids, _, _ in parts for d in ids]
    assert (np.concatenate([c for _, c, _ in found]) == np.concatenate(counts)).all()
    assert (np.concatenate([x for _, _, x in found]) == np.concatenate([x for _, x, _ in parts])).all()
    for (ids, c, x), after in zip(found, [*found[1:], None]):
        assert c.sum() == len(x) and (len(x) <= 64 or len(ids) == 1) and (after is None or len(x) + after[1][0] > 64)
    texts = ["", None, "a b " * 200, "c", *random_texts(60, 6), "d " * 64, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(tokens._together(iter([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3, 20), batch.slice(23)])))
    assert [d for docs, _ in got for d in docs] == list(range(len(texts))) and [t for _, x in got for t in x.to_pylist()] == texts
    check_files(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_checksums_without_rows_of_ids(spark, odd, tmp_path):
    """The digest told where ids are read is that of the ids as rows; the plan of the round trip has one step in Python."""
    tokens.write_tokens(odd, f"{tmp_path}/ids", WORD).write.parquet(f"{tmp_path}/manifest")
    manifest = spark.read.parquet(f"{tmp_path}/manifest")
    direct, apart = tokens.read_checksums(manifest), tokens.with_checksum(tokens.read_tokens(manifest))
    assert direct.schema == apart.schema and sorted(map(tuple, direct.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)
    assert tokens.round_trip(odd, WORD)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def check_files(spark, df):
    library = Tokenizer.from_file(WORD)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokens.round_trip(df, WORD).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_files(spark, odd, none, monkeypatch):
    check_files(spark, odd)
    assert tokens.round_trip(none, WORD).collect() == []


def test_long_document_spans_superblocks(tmp_path):
    flat = np.arange(2 * idcodec.BLOCK + 5, dtype=np.uint16)
    old, tokens.SECTION_IDS = tokens.SECTION_IDS, idcodec.BLOCK
    try:
        data = idcodec.MAGIC + tokens._section([None, 7], np.array([5, len(flat) - 5]), flat)
    finally:
        tokens.SECTION_IDS = old
    import io

    (docs, counts, ids), = tokens.sections(io.BytesIO(data))
    assert docs == [None, 7] and counts.tolist() == [5, len(flat) - 5] and (ids == flat).all()


def test_bpe_columns(spark, odd, none):
    library = Tokenizer.from_file(BYTE)
    apart, done = bpe.decode(bpe.encode(odd, BYTE), BYTE), bpe.round_trip(odd, BYTE)
    assert sorted(done.columns) == sorted(odd.columns) and apart.columns == done.columns
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, done.collect()))
    for r in done.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert bpe.round_trip(none, BYTE).collect() == []
    unknown = spark.createDataFrame([([262, -1, 99999],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(unknown, BYTE).collect()] == [" the", ""]
