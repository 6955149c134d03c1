"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. Whether a proposal is what the ordered
merges give is then tested for all adjacent pairs of all new words at once: a pair is compatible if, while
both tokens are built from bytes, no merge ever crosses the border between them. A word whose tokens can
each be built and whose pairs are all compatible is encoded as proposed; only the others are merged one by
one. Short chunks are remembered per worker up to a bound of number and length, so that each is worked on about once.

``round_trip`` encodes and decodes in one pass, with one vocabulary in each worker; ``encode`` and ``decode`` are its halves.

Results equal the tokenizers library's for byte-level BPE files of its format with
``add_special_tokens=False``: added tokens found in a text keep their ids, as in the library.

Edge cases: null text is an empty text, which has no ids; decoding no ids gives an empty text; null ids
decode to an empty text; ids outside the vocabulary are ignored, as in the library. Repeated rows give repeated
rows, empty tables give empty tables. Other columns pass through untouched; a column that has the name of
an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cache, mapped, text_slices

#: The split pattern of the byte-level pre-tokenizer of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A coarser split whose borders are always borders of SPLIT too, where both agree about white space.
#: Letters up to white space, a full stop or a comma come first, and these marks up to white space next.
COARSE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\s.,]|\Z)|[.,]+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space, Unicode (and so the library) doesn't.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: Chunks a worker remembers, the first ones, which have most of the frequent words, and their characters at most: some 50 MB.
REMEMBERED, REMEMBERED_CHARS = 200_000, 40
NEVER = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies write bytes: printable Latin-1 bytes stand for
    themselves, the others are numbered from 256 on in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder and decoder of one vocabulary file's text (JSON)."""

    def __init__(self, spec: str):
        self._read(json.loads(spec))
        self._spines()
        self.remembered: dict[str, bytes] = {}

    def _read(self, spec: dict) -> None:
        alphabet = byte_alphabet()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece: list[bytes] = [b""] * self.size
        self.ids: dict[bytes, int] = {}
        for text, i in vocab.items():
            self.piece[i] = bytes(alphabet[c] for c in text)
            self.ids[self.piece[i]] = i
        for text, i in self.special.items():
            self.piece[i] = text.encode()
        self.longest = max(map(len, self.ids))
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.made_at = np.full(self.size, NEVER, np.int64)
        keys = np.empty(len(pairs), np.int64)
        self.merge_at: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys[rank] = x * self.size + y
            self.merge_at.setdefault(x * self.size + y, (rank, z))
            if self.made_at[z] == NEVER:
                self.left[z], self.right[z], self.made_at[z] = x, y, rank
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs, NEVER where there is none."""
        key = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _spines(self) -> None:
        """Per token, its first (last) parts from a byte up to itself, with the rank at which each is merged."""

        def spine(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            now, levels = np.arange(self.size), []
            while True:
                levels.append(now)
                down = np.where(side[now] >= 0, side[now], now)
                if (down == now).all():
                    break
                now = down
            nodes = np.stack(levels[::-1], 1)  # from the byte to the token; short spines repeat the byte
            until = np.full(nodes.shape, NEVER, np.int64)
            until[:, :-1] = np.where(nodes[:, 1:] != nodes[:, :-1], self.made_at[nodes[:, 1:]], -1)
            return nodes.astype(np.int32), until.astype(np.int32)

        self.last, self.last_until = spine(self.right)
        self.first, self.first_until = spine(self.left)
        whole = np.flatnonzero(self.left >= 0)
        self.buildable = np.array([len(p) == 1 for p in self.piece])
        fine = np.zeros(self.size, bool)
        fine[whole] = self.compatible(self.left[whole], self.right[whole], until_whole=True)
        for z in whole[np.argsort(self.made_at[whole], kind="stable")]:
            self.buildable[z] = fine[z] and self.buildable[self.left[z]] and self.buildable[self.right[z]]

    def compatible(self, a: np.ndarray, b: np.ndarray, until_whole: bool = False) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses the border between them.

        The border's neighbours are a part x of ``a`` and a part y of ``b``. They stay until x or y is
        merged within its own token, the earlier rank first and the left one first at equal ranks. The
        pair is broken if the merge of (x, y) comes before that. ``until_whole``: that the two whole tokens
        themselves merge doesn't count.
        """
        good = np.ones(len(a), bool)
        row = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        top_i, top_j = self.last.shape[1] - 1, self.first.shape[1] - 1
        while len(row):
            x, y = self.last[a[row], i], self.first[b[row], j]
            stays_x, stays_y = self.last_until[a[row], i], self.first_until[b[row], j]
            done = (i == top_i) & (j == top_j)
            rank = self._rank(x, y)
            broken = (rank < stays_x) & (rank <= stays_y) & (rank != NEVER)
            # a repeated byte at the foot of a short spine is no part of its own
            broken &= (stays_x != -1) & (stays_y != -1)
            if until_whole:
                broken &= ~done
            good[row[broken]] = False
            left = stays_x <= stays_y
            i, j = i + (left & ~done), j + (~left & ~done)
            keep = ~(broken | done)
            row, i, j = row[keep], i[keep], j[keep]
        return good

    def _propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                raise ValueError(f"byte {word[at]} isn't in the vocabulary")
        return out

    def _merged(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost first at equal ranks."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > 256:
            return self._merged_long(parts)
        find, none, size = self.merge_at.get, (NEVER, -1), self.size
        ranks = [find(x * size + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = find(parts[at - 1] * size + best[1], none)
            if at < len(ranks):
                ranks[at] = find(best[1] * size + parts[at + 1], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        import heapq

        n, merge_at, size = len(parts), self.merge_at, self.size
        after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (m := merge_at.get(parts[k] * size + parts[after[k]])) is not None:
                heapq.heappush(heap, (m[0], k, parts[k], parts[after[k]], m[1]))

        for k in range(n):
            offer(k)
        while heap:
            _, k, x, y, z = heapq.heappop(heap)
            if parts[k] != x or after[k] < 0 or parts[after[k]] != y:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = z, -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words: proposed for all, verified for all at once, merged where that fails."""
        out = [self._propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for x in out for i in x), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(out)), sizes)
        bad = np.zeros(len(out), bool)
        bad[word[~self.buildable[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fine = self.compatible(pairs // self.size, pairs % self.size)
            bad[word[inner[~fine[back]]]] = True
        for k in np.flatnonzero(bad):
            out[k] = self._merged(words[k])
        return out

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        fine: dict[str, list[str]] = {}
        words: dict[str, int] = {}
        for c in chunks:
            fine[c] = _split(c)
            for w in fine[c]:
                words.setdefault(w, len(words))
        ids = [np.array(x, np.int32).tobytes() for x in self.encode_words([w.encode() for w in words])]
        return {c: b"".join(ids[words[w]] for w in parts) for c, parts in fine.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts: list[tuple[int, str | None, int]] = []  # text, chunk source, special id
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.special_split is None or not any(s in text for s in self.special):
                parts.append((k, text, -1))
            else:
                parts += [(k, None, self.special[p]) if p in self.special else (k, p, -1) for p in self.special_split.split(text) if p]
        chunked = [None if p is None else COARSE.findall(p) if not ODD_SPACE.search(p) else _split(p) for _, p, _ in parts]
        known, forget = self.remembered, []
        if missing := {c for x in chunked if x for c in x if c not in known}:
            room = REMEMBERED - len(known)
            known.update(self._learn(missing))
            forget = [c for k, c in enumerate(missing) if k >= room or len(c) > REMEMBERED_CHARS]
        out: list[list[bytes]] = [[] for _ in texts]
        for (k, _, special), chunks in zip(parts, chunked, strict=True):
            out[k].append(np.array([special], np.int32).tobytes() if chunks is None else b"".join(map(known.__getitem__, chunks)))
        for c in forget:
            del known[c]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; those outside of the vocabulary have none."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


_split = regex.compile(SPLIT).findall


def coder_of(spec: str) -> SpeculativeBPE:
    """One coder per worker and vocabulary."""
    held, key = cache(__name__), hashlib.sha256(spec.encode()).hexdigest()
    if key not in held:
        held[key] = SpeculativeBPE(spec)
    return held[key]


def read_spec(path: str) -> str:
    """The vocabulary file's text; a few MB at most, so that it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    return text


def replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """``schema`` with a last column ``name``, instead of any of that name."""
    return T.StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _ids(bpe: SpeculativeBPE, texts: pa.Array) -> pa.ListArray:
    got = [x for part in text_slices(texts) for x in bpe.encode(part)]
    ends = np.zeros(len(got) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in got], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), np.int32)))


def _texts(bpe: SpeculativeBPE, ids: pa.ListArray) -> pa.Array:
    if ids.null_count:
        return pa.array([bpe.decode(np.array(x or [], np.int32)) for x in ids.to_pylist()], pa.string())
    ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    return pa.array([bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _coded(df: DataFrame, vocab_path: str, text_col: str | None, ids_col: str, out_col: str | None) -> DataFrame:
    """Adds ``ids_col`` from ``text_col``, and ``out_col`` from ``ids_col``, or one of them."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    schema = df.schema
    if text_col is not None:
        schema = replaced(schema, ids_col, T.ArrayType(T.IntegerType(), False))
    if out_col is not None:
        schema = replaced(schema, out_col, T.StringType())
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(spec.value)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            made = {ids_col: _ids(bpe, column(text_col))} if text_col is not None else {ids_col: column(ids_col)}
            if out_col is not None:
                made[out_col] = _texts(bpe, made[ids_col])
            yield pa.RecordBatch.from_arrays([made[c] if c in made else column(c) for c in names], names=names)

    return mapped(df, run, schema)


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col`` array<int>, the ids of the whole ``text_col``."""
    return _coded(df, vocab_path, text_col, out_col, None)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` string, the text of ``ids_col``; special tokens are kept in it."""
    return _coded(df, vocab_path, None, ids_col, out_col)


def round_trip(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``ids_col``, the ids of the whole ``text_col``, and ``out_col``, the text that they decode to, in one pass."""
    return _coded(df, vocab_path, text_col, ids_col, out_col)
