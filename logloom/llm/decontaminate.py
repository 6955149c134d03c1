"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words (runs of letters, digits and underscores, in lower case). An item of m words is leaked where a run of a document's words is at
most ``EDITS`` * m word edits away from it.

1. Windows of an item's size start at every word of every document. A run within e edits of an item of m words shares m - 1 - 2e of its
   word pairs at least, so that windows with fewer word pairs of the items of that size can't start a leak; they are left out, without loss.
2. The others are embedded by the CGK random walk: at each of 3m steps the current word is put out, and a random bit of step and word
   tells whether to go on to the next (steps from 2m on, near the end, aren't sampled). Sequences at a small edit distance have a small Hamming distance then.
3. Bit sampling: ``SAMPLES`` random choices of ``BITS`` steps, before the walk nears its end, on each of ``WALKS`` walks are the hash keys. A window and an item of its size that share a key
   are candidates.
4. Candidates are verified by exact edit distance, over all ends of the run.

Walks of long sequences drift apart with the number of edits, so items of over ``WHOLE`` words are looked for by parts of ``PART`` words at most: where a run is within the
allowed edits of the item, one of the parts at least is within its own of a part of the run. Around each part found, the run nearest to the whole item is taken, over all starts and ends.

Items are written in blocks of bounded size. One pass over the texts takes the blocks in turn, from the shared folder; a worker keeps the last few of them.

Edge cases: null and empty texts and items have no words and no match. Items of one word match that word. Repeated items are found
each, by their ids; repeated rows each have their hits, and of equal matches of an item the first counts. Very long texts are searched whole. An empty benchmark leaves all documents without
hits, an empty table gives an empty one. Columns of the name of the output column are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import replaced
from .common import cache, mapped, mixed, shuffle_partitions, text_slices, work_dir

EDITS = 0.2
WALKS, SAMPLES, BITS = 16, 8, 4
#: Words of the longest items that are embedded as a whole, and of a longer item's parts at most.
WHOLE, PART = 60, 50
#: Items of a block, and their characters together, at most.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
#: Blocks that a worker keeps.
BLOCKS_KEPT = 3
#: Bytes of text that are searched at a time.
SLICE = 8 << 20
#: Windows that are embedded at a time.
WINDOWS = 4000
#: Numbers of words: what follows a text's end, any word that no item has, and the first of the items' own.
END, OTHER, KNOWN = 0, 1, 2
TOKEN = re.compile(r"\w+")
HIT = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("item_id", T.LongType()), ("distance", T.LongType()), ("n_words", T.LongType()), ("start", T.LongType()), ("end", T.LongType()))]))
_HIT = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "n_words", "start", "end")]))


def most_edits(m: int) -> int:
    return int(EDITS * m + 1e-9)


def prefix_distances(item: list[int], words: list[int]) -> tuple[int, int]:
    """The smallest edit distance of the item to a beginning of ``words``, and the length of the shortest such beginning; bit-parallel."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        where[w] |= 1 << k
    up, down, now = mask, 0, m
    best, at = m, 0
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & mask
        right_down = up & diagonal
        now += bool(right_up & high) - bool(right_down & high)
        right_up = (right_up << 1 | 1) & mask
        right_down = right_down << 1 & mask
        up = right_down | ~(diagonal | right_up) & mask
        down = right_up & diagonal
        if now < best:
            best, at = now, j + 1
    return best, at


def last_end(item: list[int], words: list[int]) -> tuple[int, int]:
    """The smallest edit distance of the item to any run of ``words``, and the first end of such a run; bit-parallel."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        where[w] |= 1 << k
    up, down, now = mask, 0, m
    best, at = m, 0
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & mask
        right_down = up & diagonal
        now += bool(right_up & high) - bool(right_down & high)
        right_up = right_up << 1 & mask  # a run may start at any word
        right_down = right_down << 1 & mask
        up = right_down | ~(diagonal | right_up) & mask
        down = right_up & diagonal
        if now < best:
            best, at = now, j + 1
    return best, at


def nearest_run(item: list[int], words: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the run of ``words`` that is nearest to the item; the first end and the shortest of equal ones."""
    distance, end = last_end(item, words)
    return distance, end - prefix_distances(item[::-1], words[:end][::-1])[1], end


class Items:
    """A block of benchmark items, by their number of words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        #: Per size, the numbers of those of by_size that are parts: the item's words, and the part's place among them.
        self.part_of: dict[int, dict[int, tuple[np.ndarray, int]]] = defaultdict(dict)
        pairs, self.longest = [], 0
        for item, text in rows:
            words = np.array([self.vocab.setdefault(w, len(self.vocab) + KNOWN) for w in TOKEN.findall(text.lower())], np.uint64)
            if not len(words):
                continue
            self.longest = max(self.longest, len(words) + most_edits(len(words)))
            pairs.append(_pairs(words))
            at = 0
            for part in np.array_split(words, -(-len(words) // PART)) if len(words) > WHOLE else [words]:
                if len(part) < len(words):
                    self.part_of[len(part)][len(self.by_size[len(part)])] = words, at
                self.by_size[len(part)].append((item, part))
                at += len(part)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.of_size = {m: np.isin(self.pairs, np.concatenate([_pairs(w) for _, w in items])) for m, items in self.by_size.items()}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        self.keys = {m: [self._keyed(k) for k in _sampled(np.stack([w for _, w in items]), np.arange(len(items)), m)] for m, items in self.by_size.items() if m > 1}

    @staticmethod
    def needed(m: int) -> int:
        """Word pairs that a run within the allowed edits of an item of ``m`` words shares with it at least."""
        return max(1, m - 1 - 2 * most_edits(m))

    @staticmethod
    def _keyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def hit_pairs(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that form a word pair of some item with the next, and which pair that is."""
        if not len(self.pairs) or len(flat) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = flat >= KNOWN
        at = np.flatnonzero(known[:-1] & known[1:])
        key = _pairs(np.stack([flat[at], flat[at + 1]]))[0]
        maybe = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
        at, key = at[maybe], key[maybe]
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        real = self.pairs[found] == key
        return at[real], found[real]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; OTHER for all that no item has."""
        return np.fromiter(map(self.vocab.get, words, repeat(OTHER)), np.uint64, len(words))

    def starts(self, places: np.ndarray, m: int) -> np.ndarray:
        """Starts of windows that hold as many of ``places`` as a leak of an item of ``m`` words must."""
        need, width = self.needed(m), m + most_edits(m) - 1
        if len(places) < need:
            return np.zeros(0, np.int64)
        first, last = places[: len(places) - need + 1], places[need - 1 :]
        near = np.flatnonzero(last - first < width)
        begin, end = np.maximum(last[near] - width + 1, 0), first[near] + 1
        if not len(near):
            return near
        sizes = end - begin
        return np.unique(np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()))

    def candidates(self, flat: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(size, start, number of the item) of windows that share a key with an item. ``flat`` has zeros after each text."""
        places, pair = self.hit_pairs(flat)
        for m, items in self.by_size.items():
            if m == 1:
                for k, (_, words) in enumerate(items):
                    yield from ((1, int(s), k) for s in np.flatnonzero(flat == words[0]))
                continue
            starts = self.starts(places[self.of_size[m][pair]], m)
            starts = starts[flat[starts] != 0]
            if not len(starts):
                continue
            padded = np.concatenate([flat, np.zeros(m, np.uint64)])
            for at in range(0, len(starts), WINDOWS):
                part = starts[at : at + WINDOWS]
                found: set[tuple[int, int]] = set()
                for (keys, order), own in zip(self.keys[m], _sampled(padded, part, m), strict=True):
                    low = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    for k in np.flatnonzero(keys[low] == own):
                        found.update((int(part[k]), int(i)) for i in order[low[k] : np.searchsorted(keys, own[k], "right")])
                yield from ((m, s, i) for s, i in sorted(found))


def _pairs(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


def _sampled(words: np.ndarray, at: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """WALKS * SAMPLES key arrays of windows of ``m`` words: rows of a matrix, or at places of a flat array."""
    busy = max(1, int(2 * m - 2 * m**0.5))  # later steps mostly put out what follows the end, which all windows share
    rng = np.random.default_rng(1000 + m)
    i = np.zeros((WALKS, len(at)), np.int64)
    out = np.zeros((busy, WALKS, len(at)), np.uint64)
    seeds = (np.arange(WALKS, dtype=np.uint64) * np.uint64(4096))[:, None]
    for j in range(busy):
        inside = i < m
        k = np.minimum(i, m - 1)
        word = words[at, k] if words.ndim == 2 else words[at + k]
        out[j] = np.where(inside, word, np.uint64(0))
        i += ((mixed(word ^ (seeds + np.uint64(j + 1))) & np.uint64(1)) == 1) & inside
    for walk in range(WALKS):
        for _ in range(SAMPLES):
            key = np.zeros(len(at), np.uint64)
            for j in rng.choice(busy, min(BITS, busy), replace=False):
                key = key * np.uint64(0x9E3779B97F4A7C15) + out[j, walk]
            yield key


def hits(texts: list[str | None], items: Items) -> list[list[dict]]:
    """Per text, the best match of each item that it has, with its span in code points."""
    words = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    gap = items.longest + 1
    begins = np.concatenate([[0], np.cumsum(sizes + gap)])
    flat = np.zeros(int(begins[-1]), np.uint64)
    for w, b in zip(words, begins, strict=False):
        flat[b : b + len(w)] = items.numbers(w)
    best: list[dict[int, tuple]] = [{} for _ in texts]
    searched: set[tuple[int, int, int]] = set()
    for m, start, k in items.candidates(flat):
        item, own = items.by_size[m][k]
        e = most_edits(m)
        doc = int(np.searchsorted(begins, start, "right")) - 1
        low, high = int(begins[doc]), int(begins[doc] + sizes[doc])
        if k in items.part_of[m]:
            whole, offset = items.part_of[m][k]
            m, more = len(whole), most_edits(len(whole))
            # candidates of nearly the same place are searched around together
            near = (start - offset) // more
            if (doc, id(whole), near) in searched:
                continue
            searched.add((doc, id(whole), near))
            first = max(low, near * more - more - e)
            distance, at, end = nearest_run(whole.tolist(), flat[first : min(high, (near + 1) * more + e + more + m + more)].tolist())
            e, length, start = more, end - at, first + at
        else:
            distance, length = prefix_distances(own.tolist(), flat[start : min(start + m + e, high)].tolist())
        if distance <= e and length:
            at = start - low
            found = (distance, at, at + length, m)
            if item not in best[doc] or found < best[doc][item]:
                best[doc][item] = found
    out = []
    for text, found in zip(texts, best, strict=True):
        spans = [m.span() for m in TOKEN.finditer(text.lower() if len(text.lower()) == len(text) else text)] if found else []
        out.append([{"item_id": i, "distance": d, "n_words": m, "start": spans[min(a, len(spans) - 1)][0], "end": spans[min(b, len(spans)) - 1][1]} for i, (d, a, b, m) in sorted(found.items())])
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Folders of the items (i, t) in parts of bounded size."""
    spark, root = benchmark.sparkSession, work_dir(benchmark.sparkSession, "items")
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not n:
        return []
    parts = max(1, -(-2 * n // BLOCK_ITEMS), -(-2 * chars // BLOCK_CHARS)) if n > BLOCK_ITEMS or chars > BLOCK_CHARS else 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    dealt.repartition(min(parts, shuffle_partitions(spark)), "block").write.partitionBy("block").parquet(root)
    return [f"{root}/block={r['block']}" for r in dealt.select("block").distinct().orderBy("block").collect()]


def items_at(path: str) -> Items:
    """A block's items, in order of their ids; the last few blocks stay in the worker."""
    held = cache(__name__)
    if path not in held:
        store, at = pafs.FileSystem.from_uri(path)
        files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
        rows = [(r["i"], r["t"]) for f in files for r in pq.read_table(f, filesystem=store, columns=["i", "t"], partitioning=None).to_pylist()]
        while len(held) >= BLOCKS_KEPT:
            del held[next(iter(held))]
        held[path] = Items(sorted(rows))
    return held[path]


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """Adds ``out_col``: array of (item_id, distance, n_words, start, end) of the items that each text leaks, by item."""
    schema = replaced(docs.schema, out_col, HIT)
    keep = [f.name for f in schema.fields[:-1]]
    paths = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for texts in text_slices(batch.column(batch.schema.get_field_index(text_col)), SLICE):
                of = [hits(texts, items_at(path)) for path in paths]
                found += [sorted((x for own in of for x in own[k]), key=lambda x: x["item_id"]) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, _HIT)], names=[*keep, out_col])

    return mapped(docs, run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document and item that it leaks."""
    rows = flagged(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", "leak.*")
