"""MinHash near-dedup with b-bit signatures.

1. Each text becomes its set of hashed word shingles; PERMS minima give band keys and a signature of their low
   BITS bits. Texts with equal sets form a class, of which one member goes on.
2. Classes that share a band key meet in tiles of a bounded size; bit counts on the packed signatures estimate the
   similarity, corrected for chance matches of b-bit values. A tile emits a spanning forest of its likely pairs.
3. The forest's components are candidate families. Each family is dealt into blocks of bounded size, and
   every likely pair of a block that isn't connected yet is confirmed on the full sets; a block
   emits a spanning forest of its confirmed links. Components of these are the result.
Groups of over one tile or block (hot keys, large families) are first compared with PIVOTS of their members, in one
pass. Members connected by these links need no comparison with each other any more; the far ones, those outside the
group's largest such part, are compared with all in tiles. So work is linear in a group of copies of one text, and
a row is copied as often only as the far ones demand.
So no step emits the pairs of a group, and no link is lost but by the odds of banding and estimate: with the
defaults below 1e-4 for a pair right at the threshold, far less above it.

Defined cases: a null, empty or blank text has an empty set, links with nothing and is kept; rows that share
a doc_id are one document; rows with a null doc_id link with nothing, have a null component and are kept;
ties keep the smallest doc_id; repeated rows get equal results; other columns are not read. doc_id is an integer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PERMS, BITS, ROWS, BANDS = 256, 4, 6, 40
#: Standard deviations that the estimate may fall short by.
SLACK = 4.0
TILE = 1024
#: Shingles of a block's half.
BLOCK = 400_000
#: Members of a large group that all others are compared with first.
PIVOTS = 4

_seed = np.random.default_rng(20240601)
_A = (_seed.integers(0, 2**31, PERMS, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _seed.integers(0, 2**32, PERMS, dtype=np.int64).astype(np.uint32)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and the n + 1 offsets of the rows."""
    hashes, rows, at = C.word_hashes(column)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    length = np.minimum(n[row], size)
    value = np.zeros(len(first), C.U64)
    for k in range(size):
        inside = length > k
        word = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else value
        value = np.where(inside, C.mix(value * C.U64(C.MULT) + word + C.U64(k + 1)), value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1), side="left")


def signatures(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signatures (bit planes) and band keys of the rows, none of which is empty."""
    x = (value >> C.U64(32)).astype(np.uint32)
    minima = np.empty((len(at) - 1, PERMS), np.uint32)
    for k in range(PERMS):
        minima[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], at[:-1])
    planes = [np.packbits((minima >> np.uint32(b)) & np.uint32(1), axis=1) for b in range(BITS)]
    keys = np.zeros((len(minima), BANDS), C.U64)
    for band in range(BANDS):
        h = np.full(len(minima), C.U64(band + 1))
        for k in range(ROWS):
            h = C.mix(h * C.U64(C.MULT) + minima[:, band * ROWS + k])
        keys[:, band] = h
    return np.concatenate(planes, axis=1), keys


WIDTH = PERMS * BITS // 8


def least_matches(percent: int) -> int:
    """Equal b-bit values that a pair at the threshold has at least, less SLACK standard deviations."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return math.floor(PERMS * p - SLACK * math.sqrt(PERMS * p * (1 - p)))


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal b-bit values of signatures a and b (broadcast over all axes but the last, of 64-bit words)."""
    words = PERMS // 64
    differ = a[..., :words] ^ b[..., :words]
    for k in range(1, BITS):
        differ |= a[..., k * words : (k + 1) * words] ^ b[..., k * words : (k + 1) * words]
    return PERMS - np.bitwise_count(differ).sum(-1, dtype=np.int32)


def forest(likely: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a graph given by its boolean adjacency rows."""
    n = len(likely)
    fresh, out = np.ones(n, bool), []
    for seed in range(n):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            near = np.flatnonzero(likely[i] & fresh)
            fresh[near] = False
            out += [(i, int(j)) for j in near]
            stack += near.tolist()
    return out


def _likely_edges(sig: np.ndarray, half: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Forest of the likely pairs of one tile; in a tile of two halves, of those across."""
    n = len(sig)
    two = half.min() != half.max()
    likely = np.zeros((n, n), bool)
    for a in range(0, n, 128):
        likely[a : a + 128] = matches(sig[a : a + 128, None], sig[None]) >= least
    if two:
        likely &= half[:, None] != half[None]
    np.fill_diagonal(likely, False)
    return forest(likely)


def _tiles(least: int):
    def run(batches):
        for t, at in C.groups(batches, ["key", "ti", "tj"], 1 << 14):
            ids = t.column("id").to_numpy()
            half = t.column("half").to_numpy()
            sig = C.fixed_bytes(t.column("sig"), WIDTH).copy().view(C.U64)
            a, b = [], []
            sizes = np.diff(at)
            left = np.repeat(at[1:], sizes) - np.arange(t.num_rows)  # rows to the group's end
            small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
            for d in range(1, 8):
                i = np.flatnonzero(small & (left > d))
                if len(i):
                    i = i[matches(sig[i], sig[i + d]) >= least]
                    a.append(ids[i])
                    b.append(ids[i + d])
            for g in np.flatnonzero(sizes > 8).tolist():
                s = slice(at[g], at[g + 1])
                e = np.array(_likely_edges(sig[s], half[s], least), np.int64).reshape(-1, 2) + at[g]
                a.append(ids[e[:, 0]])
                b.append(ids[e[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _confirm(percent: int, least: int):
    def run(batches):
        for t, at in C.groups(batches, ["family", "ti", "tj"], 64):
            ids, half = t.column("id").to_numpy(), t.column("half").to_numpy()
            sig = C.fixed_bytes(t.column("sig"), WIDTH).copy().view(C.U64)
            sets = [np.frombuffer(x.as_buffer(), C.U64) for x in t.column("shingles")]
            size = np.array([len(s) for s in sets], np.int64)
            a, b = [], []
            for g0, g1 in zip(at[:-1].tolist(), at[1:].tolist()):
                two = half[g0:g1].min() != half[g0:g1].max()
                seen = C.Union(g1 - g0)
                for i in range(g0, g1):
                    j = np.arange(i + 1, g1)
                    if two:
                        j = j[half[j] != half[i]]
                    # sizes bound the similarity: min * 100 >= percent * max
                    j = j[(100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
                    if not len(j):
                        continue
                    m = matches(sig[i], sig[j])
                    order = np.argsort(-m, kind="stable")
                    for k in j[order[: int((m >= least).sum())]].tolist():
                        if seen.find(i - g0) == seen.find(k - g0):
                            continue
                        both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                        if 100 * both >= percent * (size[i] + size[k] - both):
                            seen.join(i - g0, k - g0)
                            a.append(ids[i])
                            b.append(ids[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return run


def _paired(rows: DataFrame, parts: str, group: list[str]) -> DataFrame:
    """Rows dealt to tiles: part i of n meets each part j, in tile (min, max); half tells which of the two."""
    part = F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    return (
        rows.withColumn("__p", part)
        .withColumn("__q", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
        .withColumn("ti", F.least("__p", "__q"))
        .withColumn("tj", F.greatest("__p", "__q"))
        .withColumn("half", F.when(F.col("__p") == F.col("tj"), 1).otherwise(0))
        .drop("__p", "__q", parts)
        .repartition(*group, "ti", "tj")
        .sortWithinPartitions(*group, "ti", "tj")
    )


def _marks(group: str, linked, most: int):
    """Mask and ids of the pivots that each row links with. A block's pivots come first; linked() tells rows (down) by pivots (across)."""

    def run(batches):
        for t, at in C.groups(batches, [group, "part"], most):
            ids, slot = t.column("id").to_numpy(), t.column("slot").to_numpy().astype(np.int32)
            pivots = np.add.reduceat(t.column("pivot").to_numpy().astype(np.int64), at[:-1])
            out, masks, links, sizes = [], [], [], []
            for lo, k, hi in zip(at[:-1].tolist(), pivots.tolist(), at[1:].tolist()):
                if lo + k == hi:
                    continue
                near = linked(t.slice(lo, hi - lo), k)
                out.append(np.arange(lo + k, hi))
                masks.append((near << slot[lo : lo + k]).sum(1, dtype=np.int32))
                links.append(np.broadcast_to(ids[lo : lo + k], near.shape)[near])
                sizes.append(near.sum(1, dtype=np.int32))
            if out:
                rows = pa.array(np.concatenate(out))
                offsets = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [t.column(group).take(rows).combine_chunks(), t.column("id").take(rows).combine_chunks(), pa.array(np.concatenate(masks)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))],
                    [group, "id", "mask", "links"],
                )

    return run


def _likely(least: int):
    def linked(t, k):
        sig = C.fixed_bytes(t.column("sig"), WIDTH).copy().view(C.U64)
        return matches(sig[k:, None], sig[None, :k]) >= least

    return linked


def _exact(percent: int, least: int):
    def linked(t, k):
        sig = C.fixed_bytes(t.column("sig"), WIDTH).copy().view(C.U64)
        near = matches(sig[k:, None], sig[None, :k]) >= least
        sets = [np.frombuffer(x.as_buffer(), C.U64) for x in t.column("shingles")]
        for i, j in zip(*np.nonzero(near)):
            a, b = sets[k + i], sets[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                near[i, j] = False
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            near[i, j] = 100 * both >= percent * (len(a) + len(b) - both)
        return near

    return linked


def _through_pivots(rows: DataFrame, parts: str, group: str, linked, most: int) -> tuple[DataFrame, DataFrame]:
    """Links of large groups' rows with pivots (a, b), and the tiles of pairs that these leave open. `rows` is read thrice.

    A group's main part is the pivots that rows link, directly or by turns, with the pivots most rows have in common.
    """
    slot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(PIVOTS)).cast("int")
    chosen = rows.groupBy(group, slot.alias("slot")).agg(F.min("id").alias("id"))
    pivots = rows.join(chosen, [group, "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    members = rows.withColumn("slot", F.lit(0)).withColumn("part", F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))
    met = pivots.withColumn("pivot", F.lit(1)).unionByName(members.withColumn("pivot", F.lit(0)))
    met = met.repartition(group, "part").sortWithinPartitions(group, "part", F.desc("pivot"))
    marked = C.materialise(met.mapInArrow(_marks(group, linked, most), f"{group} long, id long, mask int, links array<long>"), "minhash-marked")

    kinds = marked.groupBy(group, "mask").agg(F.count("*").alias("n"))  # 2 ** PIVOTS of a group at most
    main = kinds.groupBy(group).agg(F.sum("n").alias("n"), F.max_by("mask", F.when(F.col("mask") > 0, F.col("n"))).alias("main"), F.collect_list(F.struct("mask", "n")).alias("kinds"))
    meets = lambda mask, main: mask.bitwiseAND(main) != 0
    for _ in range(PIVOTS - 1):
        main = main.withColumn("main", F.aggregate("kinds", F.col("main"), lambda m, x: F.when(meets(x["mask"], m), m.bitwiseOR(x["mask"])).otherwise(m)))
    apart = F.aggregate(F.filter("kinds", lambda x: ~meets(x["mask"], F.col("main"))), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    main = C.materialise(main.select(group, "n", "main", apart.alias("apart")).where("apart > 0"), "minhash-main")
    label = C.join_hot(marked, main, [group], "n", max(marked.count(), 1)).select(group, "id", (~meets(F.col("mask"), F.col("main"))).alias("far"), (F.col("apart") / F.col("n")).alias("share"))
    open_ = rows.join(label, [group, "id"]).withColumn("few", F.ceil(F.col(parts) * F.col("share"))).drop("share")

    among = _paired(open_.where("far").drop("far", parts), "few", [group])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    far = open_.where("far").withColumn("ti", -1 - own("few")).withColumn("tj", each(parts)).withColumn("half", F.lit(1))
    near = open_.where("not far").withColumn("tj", own(parts)).withColumn("ti", each("few")).withColumn("ti", -1 - F.col("ti")).withColumn("half", F.lit(0))
    across = far.unionByName(near).drop("far", "few", parts).repartition(group, "ti", "tj").sortWithinPartitions(group, "ti", "tj")
    return marked.select(F.explode("links").alias("a"), F.col("id").alias("b")), among.unionByName(across)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: links are 100 * common >= percent * united shingles."""
    spark = docs.sparkSession
    least = least_matches(percent)

    def describe(batches):
        for big in batches:
            for b in C.slices(big, "text"):
                value, at = shingle_sets(b.column("text"), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                starts = np.append(at[:-1][full], len(value))
                null = n == 0
                h1, h2 = np.zeros(len(n), C.U64), np.zeros(len(n), C.U64)
                sig, keys = [None] * len(n), [None] * len(n)
                if len(full):
                    h1[full] = C.mix(np.add.reduceat(C.mix(value + C.U64(1)), starts[:-1]))
                    h2[full] = C.mix(np.add.reduceat(C.mix(value ^ C.U64(C.MULT)), starts[:-1]))
                    packed, bands = signatures(value, starts)
                    for k, i in enumerate(full.tolist()):
                        sig[i] = packed[k].tobytes()
                        keys[i] = bands[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("x"), pa.array(n), pa.array(h1.view(np.int64), mask=null), pa.array(h2.view(np.int64), mask=null), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "x", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("x"))
    info = C.materialise(rows.mapInArrow(describe, "id long, x long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"), "minhash-info")
    total = info.count()
    live = info.where("id is not null and h1 is not null")
    classes = C.materialise(live.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "minhash-classes")
    reps = live.join(classes.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    reps = C.materialise(reps.select("id", "x", "n_shingles", "sig", "bands"), "minhash-reps")
    n_keys = reps.count() * BANDS

    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = C.materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "minhash-keys")
    met = C.join_hot(keys, shared, ["key"], "n", n_keys)
    met = met.join(reps.select("id", "sig"), "id").withColumn("parts", F.ceil(F.col("n") / TILE)).drop("n")
    likely = _paired(met.where("parts = 1"), "parts", ["key"]).mapInArrow(_tiles(least), "a long, b long")
    spent = []
    if not shared.where(F.col("n") > TILE).isEmpty():
        spent.append(C.materialise(met.where("parts > 1"), "minhash-hot"))
        star, tiles = _through_pivots(spent[-1], "parts", "key", _likely(least), 1 << 14)
        likely = likely.unionByName(star).unionByName(tiles.mapInArrow(_tiles(least), "a long, b long"))
    families = C.components(likely)
    families = C.materialise(families.withColumnRenamed("component_id", "family").withColumnRenamed("node", "id"), "minhash-families")

    sizes = families.join(reps.select("id", "n_shingles"), "id").groupBy("family").agg(F.sum("n_shingles").alias("w"))
    member = families.join(sizes, "family").withColumn("parts", F.ceil(F.col("w") / BLOCK)).drop("w")

    def sets(batches):
        for big in batches:
            for b in C.slices(big, "text"):
                value, at = shingle_sets(b.column("text"), size)
                raw = [value[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("family"), b.column("parts"), b.column("sig"), pa.array(raw, pa.binary())], ["id", "family", "parts", "sig", "shingles"])

    known = member.join(reps.select("id", "x", "sig"), "id")  # x: of the text that stands for its class
    texts = rows.join(known, ["id", "x"]).select("id", "x", "text", "family", "parts", "sig").dropDuplicates(["id", "x"])
    schema = "id long, family long, parts long, sig binary, shingles binary"
    # the texts are shuffled once, for small and large families
    blocks = C.materialise(texts.mapInArrow(sets, schema), "minhash-sets")
    spent.append(blocks)
    links = _paired(blocks.where("parts = 1"), "parts", ["family"]).mapInArrow(_confirm(percent, least), "a long, b long")
    if not sizes.where(F.col("w") > BLOCK).isEmpty():
        star, tiles = _through_pivots(blocks.where("parts > 1"), "parts", "family", _exact(percent, least), 64)
        links = links.unionByName(star).unionByName(tiles.mapInArrow(_confirm(percent, least), "a long, b long"))
    found = C.components(links)
    C.discard(*spent)

    # classes are joined with their components first, then rows with their classes
    label = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    base = info.select("id", "n_shingles", "h1", "h2")
    linked = C.join_hot(base.where("id is not null and h1 is not null"), label, ["h1", "h2"], "n", total).drop("h1", "h2", "n")
    alone = base.where("id is null or h1 is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five words, 0.8), the one with the smallest id.

    Of rows that repeat a kept id, one stays too: the shortest text, then the smallest hash of the row.
    """
    names, docs = docs.columns, C.shielded(docs)
    result = near_duplicates(docs)
    gone = result.where("not kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    order = F.struct(F.length("text"), F.xxhash64(*docs.columns))
    again = rest.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*")).toDF(*names)
