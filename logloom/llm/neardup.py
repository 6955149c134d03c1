"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles. One hash of each shingle picks one of ``REGISTERS`` buckets, which keeps the smallest rest in
compressed form: its count of leading zeros and the next ``MANTISSA`` bits. Bands of four registers, 64 bits, are the keys that
candidates share. With 32 bands, a pair of similarity 0.8 shares none with a probability of (1 - 0.8**4)**32, 5e-8.

1. Documents with equal sets are one class; the class works from here on as its smallest document id.
2. In each band's bucket a pseudo-random member of its own is the hub; members pair up with hubs only. Pairs are dropped whose estimated similarity,
   corrected for registers that agree by accident, is five standard errors below the threshold, or whose registers differ
   in more places than the sets may differ in shingles.
3. The others are verified on the full sets, each member with one of its hubs first, and with further ones only as long as they aren't in one part
   (connected by links that were found). This is linear in the number of pairs.
4. Where a bucket has members of several parts, two of them may be similar while neither is to the hub. Members of different parts are compared by their registers, block by block; blocks of
   a large part don't meet each other. Those that may be linked to another part are verified on their full sets in the same way, within families of parts that any of them ties together: two blocks
   that meet in a task are verified by counting all intersections exactly, and give a spanning forest of the links found.
5. Components of all links are the groups; the smallest document id of each stays.

A large group of near copies is mostly one part after step 3, so that no number of its members meets more than a few others. No pairs of a group are listed, and none of it is gathered but two blocks at a time.

Edge cases: null and empty texts, and texts without a word, have an empty set, which is linked with nothing. A text of fewer words than a
shingle has its whole sequence as its one shingle. Rows with a null id have their counts, no component, and are kept.
Rows that repeat an id are one document with the links of all its texts. Very long texts are sets like others. An empty table gives an empty one. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, lower_ascii, mapped, mixed, packed, shingle_hashes, shuffle_partitions, text_slices, work_dir, written
from .components import connected

REGISTERS = 128
BANDS = REGISTERS // 4
MANTISSA = 10
#: Documents of a block, and their shingles, about.
BLOCK_DOCS, BLOCK_SHINGLES = 192, 150_000
#: Members that are verified with a hub in one task at most; more are dealt over several.
HUB_DOCS = 100
#: More documents than this are found again by a join instead of a broadcast.
BROADCAST_IDS = 400_000
COLUMNS = 2048


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of the text, A to Z in lower case."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(hashes.of(WORD.findall(lower_ascii(text))), k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers: leading zeros plus one, then the mantissa; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    h = mixed(shingles)
    bucket = (h & np.uint64(REGISTERS - 1)).astype(np.int64)
    rest = h >> np.uint64(7)  # 57 bits
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    np.minimum.at(least, bucket, rest)
    used = np.flatnonzero(least != np.uint64(2**64 - 1))
    value = np.maximum(least[used], np.uint64(1))
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    length -= (np.uint64(1) << (length - 1).astype(np.uint64)) > value  # rounding up to a power of two
    zeros = np.minimum(57 - length, 62)
    shift = length - 1 - MANTISSA
    top = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    out[used] = ((zeros + 1) << MANTISSA) | (top.astype(np.int64) & ((1 << MANTISSA) - 1))
    return out


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of register rows [pair, register] of sets of n and m, less the agreements expected by accident."""
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    large, small = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    phi = 4 * (large / small) / (1 + large / small) ** 2
    accident = 0.169919487159739093975315012348 * 2.0 ** (np.log2(REGISTERS) - MANTISSA) * phi
    return np.maximum(same - accident, 0) / np.maximum(used, 1)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, bands: the registers as 32 longs, and registers: as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, rows = [], [], []
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    s = shingle_set(text, k, hashes)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    rows.append(registers(s).view(np.int64))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            whole = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands, whole], names=["doc_id", "n_shingles", "digest", "bands", "registers"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_shingles long, digest binary, bands array<long>, registers binary")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(band, key, id, hub, n) of every document in every bucket of two or more, with a pseudo-random member as its hub."""
    keys = classes.select("id", F.posexplode("bands").alias("band", "key")).where(F.col("key") != 0)
    order = F.struct(F.xxhash64("band", "id").alias("h"), F.col("id"))
    hubs = keys.groupBy("band", "key").agg(F.min(order).alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1).select("band", "key", F.col("hub.id").alias("hub"), "n")
    # a table of its own, so that both sides of the join are dealt out, and adaptive execution can split a hot bucket
    return keys.join(written(hubs, "hubs"), ["band", "key"])


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of n and m with these register rows may be as similar as the threshold."""
    # each register that differs has a shingle of its own that only one of the sets has
    fine = (a != b).sum(-1) <= (n + m) * (1 - threshold) / (1 + threshold) + 1e-9
    fine &= np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    # a sample as large as the whole tells more than the error of a small one allows for
    least = threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    return fine & ((estimated(a, b, n, m) >= least) | (n + m < 4 * REGISTERS))


def _parts(spark) -> int:
    return max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)


def meetings(rows: DataFrame, group: list[str], weight: int | None = None) -> DataFrame:
    """``rows`` (group…, part, id, …) once for each meeting (i, j) of their block with another of the group, such that all rows of different parts meet.

    Parts of over half a block have blocks of their own, which don't meet each other. Smaller ones share blocks, each of which also meets itself. ``weight``:
    what the column ``n`` of a block may sum up to, besides BLOCK_DOCS rows.
    """
    n = rows.count()
    need = lambda count, total: F.ceil(F.greatest(count / BLOCK_DOCS, *([total / weight] if weight else []), F.lit(1.0)) if weight else F.greatest(count / BLOCK_DOCS, F.lit(1.0))).cast("int")
    total = F.sum("n") if weight else F.lit(0)
    sizes = rows.groupBy(*group, "part").agg(F.count("*").alias("rows_"), total.alias("total_"))
    sizes = written(packed(sizes.withColumn("own", F.when(need(2 * F.col("rows_"), 2 * F.col("total_")) > 1, F.col("part"))), n), "parts")
    labels = sizes.groupBy(*group, "own").agg(F.sum("rows_").alias("rows_"), F.sum("total_").alias("total_")).select(*group, "own", need(F.col("rows_"), F.col("total_")).alias("blocks"))
    labels = written(packed(labels, n), "labels")
    # a row for each large part and one for the others
    listed = labels.groupBy(*group).agg(F.collect_list(F.struct("own", "blocks")).alias("labels"))
    name = lambda own, block: F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("-")), F.lpad(block.cast("string"), 9, "0"))
    mine = rows.join(sizes.select(*group, "part", "own"), [*group, "part"]).join(written(packed(listed, n), "listed"), group)
    blocks = F.filter("labels", lambda x: x["own"].eqNullSafe(F.col("own")))[0]["blocks"]
    mine = mine.withColumn("block", name(F.col("own"), F.pmod(F.xxhash64(F.lit("block"), "id"), blocks)))
    others = F.flatten(F.transform(F.filter("labels", lambda x: x["own"].isNull() | ~x["own"].eqNullSafe(F.col("own"))), lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: name(x["own"], k))))
    met = mine.withColumn("other", F.explode(others))
    return met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("own", "labels", "block", "other")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first ``keys`` columns, without these."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def across(buckets: DataFrame, parts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): (a, a) for every document a that shares a bucket with one of another part that it may be linked to, and pairs that tie such parts together, a spanning
    forest for each two blocks.

    ``parts`` has (node, component). Buckets within one part are done.
    """
    named = buckets.select("band", "key", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    open_ = named.groupBy("band", "key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where(F.col("least") != F.col("most")).select("band", "key")
    n = buckets.count()
    rows = written(packed(named.join(written(packed(open_, n), "open"), ["band", "key"]), n), "mixed")
    met = meetings(rows, ["band", "key"]).join(classes.select("id", "n_shingles", "registers"), "id")
    met = met.select("band", "key", "i", "j", "id", "part", "n_shingles", "registers").repartition(_parts(buckets.sparkSession), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4):
            ids, part, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            if (part == part[0]).all():
                continue
            held = np.frombuffer(b"".join([r[3] for r in rows]), np.uint16).reshape(len(ids), REGISTERS)
            out, tied = [], part.copy()
            for k in range(len(ids)):
                other = np.flatnonzero(part != part[k])
                fine = other[may_link(held[k], held[other], n[k], n[other], threshold)]
                if not len(fine):
                    continue
                out.append((int(ids[k]), int(ids[k])))
                while len(fine := fine[tied[fine] != tied[k]]):
                    out.append((int(ids[k]), int(ids[fine[0]])))
                    tied[tied == tied[fine[0]]] = tied[k]
            yield _pairs_of(out)

    return mapped(met, run, "a long, b long").distinct()


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (hub, member) whose estimate is not far below the threshold."""
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("registers").alias(f"{name}_registers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: k for k, n in enumerate(batch.schema.names)}
            rows = lambda c: np.frombuffer(b"".join(batch.column(at[c]).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            a, b = rows("hub_registers"), rows("member_registers")
            n, m = np.asarray(batch.column(at["hub_n"])), np.asarray(batch.column(at["member_n"]))
            fine = may_link(a, b, n, m, threshold)
            yield batch.filter(pa.array(fine)).select([at["hub"], at["member"]])

    joined = pairs.join(side("member"), "member").join(side("hub"), "hub")
    return mapped(joined.select("hub", "member", "hub_n", "member_n", "hub_registers", "member_registers"), run, "hub long, member long")


def sets_of(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set as bytes, n) of the documents in ``ids`` (column id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                found = [shingle_set(t, k, hashes) for t in texts]
                yield pa.RecordBatch.from_pydict({"id": pa.array([next(names) for _ in texts], pa.int64()), "shingles": pa.array([s.tobytes() for s in found], pa.binary()), "n": pa.array([len(s) for s in found], pa.int64())})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return mapped(texts.join(ids, "id", "left_semi"), run, "id long, shingles binary, n long").where(F.col("n") > 0)


def hub_links(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (hub, member) that are links, as (a, b), by exact intersections. A hub's set is sent to each task with some of its members."""
    n = pairs.count()
    counts = written(packed(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_DOCS).cast("int").alias("shares")), n), "hubs")
    members = pairs.join(counts, "hub").withColumn("share", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int")).join(sets.withColumnRenamed("id", "member"), "member")
    members = members.select("hub", "share", F.lit(1).alias("kind"), "member", "shingles")
    hubs = counts.join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("hub").alias("member"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document of several texts has a set of each
        now, own = None, []
        for batch in batches:
            out = []
            for hub, share, kind, member, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (hub, share):
                    now, own = (hub, share), []
                s = np.frombuffer(shingles, np.uint64)
                if kind == 0:
                    own.append(s)
                elif any(linked(s, t, per_cent) for t in own):
                    out.append((hub, member))
            yield _pairs_of(out)

    met = hubs.unionByName(members).repartition(_parts(pairs.sparkSession), "hub", "share").sortWithinPartitions("hub", "share", "kind")
    return packed(mapped(met, run, "a long, b long").distinct(), n)


def linked(s: np.ndarray, t: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets are as similar as a link needs."""
    if 100 * min(len(s), len(t)) < per_cent * max(len(s), len(t)):
        return False
    at = np.searchsorted(t, s)
    same = int((t[np.minimum(at, len(t) - 1)] == s).sum())
    return 100 * same >= per_cent * (len(s) + len(t) - same)


def linked_in(ids: list[int], sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.diff(flat, prepend=flat[:1] - np.uint64(1)) != 0
    column = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column = (np.cumsum(often) - 1)[column[keep]]
    owner = owner[keep]
    both = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[a:b], column[a:b] % COLUMNS] = 1
            both += part @ part.T
    same = both.astype(np.int64)
    link = 100 * same >= per_cent * (sizes[:, None] + sizes[None, :] - same)
    out, done = [], np.zeros(n, bool)
    for first in range(n):
        if done[first]:
            continue
        done[first], reached = True, [first]
        while reached:
            k = reached.pop()
            more = np.flatnonzero(link[k] & ~done)
            done[more] = True
            out += [(ids[k], ids[j]) for j in more]
            reached += more.tolist()
    return out


def verified(members: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that span the groups among members (id, part, family) of one family, from exact intersections of sets (id, shingles, n)."""
    rows = written(members.join(sets, "id"), "members")
    met = meetings(rows.select("id", "part", "family", "n"), ["family"], BLOCK_SHINGLES).select("family", "i", "j", "id").join(rows.select("id", "shingles"), "id")
    met = met.select("family", "i", "j", "id", "shingles").repartition(_parts(members.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            if len(rows) > 1:
                yield _pairs_of(linked_in([i for i, _ in rows], [np.frombuffer(x, np.uint64) for _, x in rows], per_cent))

    return mapped(met, run, "a long, b long")


def _joined(links: DataFrame, more: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and their parts, which are known if there are no more links."""
    if more.isEmpty():
        return links, parts
    links = links.unionByName(more)
    return links, written(connected(links), "parts")


def groups(docs: DataFrame, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: documents of similarity ``per_cent`` or more over ``k``-word
    shingles are linked; the smallest id of each component is kept."""
    spark = docs.sparkSession
    root = work_dir(spark, "neardup")
    signatures(docs, k, id_col, text_col).write.parquet(f"{root}/signatures")
    rows = spark.read.parquet(f"{root}/signatures")
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    real.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("registers").alias("registers")).write.parquet(f"{root}/classes")
    classes = spark.read.parquet(f"{root}/classes")
    buckets = written(shared_buckets(classes), "buckets")
    near = buckets.where(F.col("id") != F.col("hub")).select("hub", F.col("id").alias("member")).distinct()
    near = written(likely(near, classes, per_cent / 100), "pairs")
    paired = written(near.select(F.explode(F.array("hub", "member")).alias("id")).distinct(), "paired")
    sets = written(sets_of(docs, paired, k, id_col, text_col), "sets")
    first = near.groupBy("member").agg(F.min_by("hub", F.xxhash64("hub")).alias("hub"))
    links = written(hub_links(first, sets, per_cent), "links")
    found = written(connected(links), "parts")
    # pairs of documents that aren't in one part yet
    part = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    rest = near.join(first, ["hub", "member"], "left_anti").join(part("hub"), "hub", "left").join(part("member"), "member", "left")
    rest = written(rest.where(F.coalesce("hub_part", "hub") != F.coalesce("member_part", "member")).select("hub", "member"), "rest")
    if not rest.isEmpty():
        more = written(hub_links(rest, sets, per_cent), "links")
        links, found = _joined(links, more, found)
    # documents that may be linked to other parts, and which parts these tie together
    ties = written(across(buckets, found, classes, per_cent / 100), "ties")
    if not ties.isEmpty():
        named = lambda c, df: df.join(found.select(F.col("node").alias(c), "component"), c, "left").withColumn(f"{c}_part", F.coalesce("component", c)).drop("component")
        both = written(named("b", named("a", ties)), "tied")
        families = connected(both, "a_part", "b_part")
        members = both.select(F.col("a").alias("id"), F.col("a_part").alias("part")).distinct().join(families.select(F.col("node").alias("part"), F.col("component").alias("family")), "part")
        members = written(members, "open")
        others = written(sets_of(docs, members.select("id").distinct().join(paired, "id", "left_anti"), k, id_col, text_col), "sets")
        links, found = _joined(links, written(verified(members, sets.unionByName(others), per_cent), "links"), found)
    # rows that repeat an id with another text tie their classes together
    named = classes.select("digest", "id").join(found, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("class_component"))
    joined = rows.join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
