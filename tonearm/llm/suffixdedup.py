"""Suffix-array dedup: bytes under a LENGTH-byte string that also starts anywhere else are removed.

Texts are dealt to tasks so that equal strings meet: every LENGTH-byte string has an anchor, the GRAM-byte piece with
the least hash in it (ties: the leftmost), and equal strings have equal anchors at equal places. The strings that share an
anchor occurrence form a stretch. Stretches whose anchor occurs once can't repeat; equal stretches are
counted and go on once (a repeated stretch is settled); groups of unequal stretches with one anchor go to a task
that builds their suffix array by the difference-cover algorithm: triples at positions not divisible by 3 are
sorted and named, the names are sorted by recursion, the remaining suffixes are merged by the rank after
them, then neighbours are compared over LENGTH bytes. Recursion stops once names span LENGTH bytes, as longer order
doesn't matter. Groups over HOT stretches are not gathered: their strings are counted by two hashes, one by one. Equal
stretches and strings are told by 128 bits of two unlike hashes each, so that chance matches don't occur at any size.

So the difference-cover sort runs in each task on its anchors' stretches, not once over a global text: a global
sort of every suffix would shuffle many times the input.

Defined cases: null and empty texts have no byte, nothing removed and the hash of the empty string; texts shorter than
LENGTH lose nothing; repeated rows lose all of their text if it has LENGTH bytes; strings never cross rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 200, 120
PIECE = 1 << 19
#: Most bytes of one suffix array: its names must fit 21 bits.
CHUNK = 400_000
#: Unequal stretches of an anchor beyond which they are counted string by string.
HOT = 4096
#: Repeated anchors up to which their hashes are broadcast (8 bytes each); beyond it they are joined.
MOST_BROADCAST = 4_000_000
#: What names a stretch: a rolling hash and Spark's own over its bytes, 128 bits together. Strings of hot groups have two as well.
NAME = ["stretch", "bytes"]
_LOW = C.U64((1 << 24) - 1)


# ---------------------------------------------------------------- difference cover
def suffix_order(s: np.ndarray, span: int, need: int, wanted: np.ndarray) -> np.ndarray:
    """Wanted positions in the order of their suffixes, exact over the first `need` bytes.

    s: names below 2**21, each standing for `span` bytes; `need` names' worth of padding must follow what is wanted.
    """
    n = len(s)
    t = np.concatenate((s, np.zeros(3, np.int64)))
    key = (t[:-3] << 42) | (t[1:-2] << 21) | t[2:-1]
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    triples = key[sample]
    # ranks are asked of wanted sample suffixes and of those just after wanted ones
    mark = np.zeros(n + 3, bool)
    mark[wanted] = True
    chosen = mark.copy()
    kind = wanted % 3
    rest = wanted[kind == 0]
    for at in (rest + 1, rest + 2, wanted[kind == 1] + 1, wanted[kind == 2] + 2):
        mark[at] = True
    asked = np.flatnonzero(mark[sample])
    if 3 * span >= need:
        order = asked[np.argsort(triples[asked], kind="stable")]
    else:
        names = np.unique(triples, return_inverse=True)[1].astype(np.int64) + 1
        order = suffix_order(names, 3 * span, need, asked)
    ordered = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    # remaining suffixes: in order of their name and the rank after it, then merged
    first = (t[rest] << 21) | rank[rest + 1]
    by = np.argsort(first, kind="stable")
    rest, first = rest[by], first[by]
    second = (t[rest] << 42) | (t[rest + 1] << 21) | rank[rest + 2]
    ordered = ordered[chosen[ordered]]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    below = np.searchsorted((t[ones] << 21) | rank[ones + 1], first, "left")
    below = below + np.searchsorted((t[twos] << 42) | (t[twos + 1] << 21) | rank[twos + 2], second, "left")
    place = np.concatenate((2 * below, 2 * np.arange(len(ordered)) + 1))
    return np.concatenate((rest, ordered))[np.argsort(place, kind="stable")]


def repeated_starts(text: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each start: whether its LENGTH bytes occur at another of the starts, or its weight is over 1."""
    padded = np.concatenate((text, np.zeros(4 * LENGTH, np.uint8)))
    order = suffix_order(padded.astype(np.int64) + 1, 1, LENGTH, starts)
    mine = np.full(len(padded), -1, np.int64)
    mine[starts] = np.arange(len(starts))
    order = order[mine[order] >= 0]
    same = np.ones(max(len(order) - 1, 0), bool)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(0, LENGTH, 8):  # compare neighbours, eight bytes at a time
        i = np.flatnonzero(same)
        if not len(i):
            break
        k = min(k, LENGTH - 8)
        a = np.ascontiguousarray(words[order[i] + k]).view(C.U64).ravel()
        b = np.ascontiguousarray(words[order[i + 1] + k]).view(C.U64).ravel()
        same[i] = a == b
    out = weight > 1
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    out[mine[order[hit]]] = True
    return out


# ---------------------------------------------------------------- anchors
def stretches(raw: np.ndarray, offsets: np.ndarray):
    """Yields (anchor hash, stretch hash, first start, number of starts) in pieces; starts count from the buffer's start."""
    w = LENGTH - GRAM + 1
    none = ~C.U64(0)
    for a in range(0, len(raw), PIECE):
        part = raw[a : a + PIECE + LENGTH - 1]
        n = len(part) - GRAM + 1
        if len(part) < LENGTH:
            return
        prefix = C.prefix_hash(part)
        at = np.arange(n)
        h = C.span_hash(prefix, at, at + GRAM)
        key = (h & ~_LOW) | at.astype(C.U64)
        padded = np.full(-(-n // w) * w, none)
        padded[:n] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])[:PIECE]  # of the strings that start here
        starts = np.arange(len(least))
        end = offsets[np.searchsorted(offsets, a + starts, side="right")]
        inside = a + starts + LENGTH <= end
        starts, anchor = starts[inside], (least[inside] & _LOW).astype(np.int64)
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        lo, gram = starts[first], anchor[first]
        whole = C.mix(C.span_hash(prefix, lo, lo + count + LENGTH - 1) + C.U64(3) * (gram - lo).astype(C.U64) + C.U64(5) * count.astype(C.U64))
        yield h[gram].view(np.int64), whole.view(np.int64), a + lo, count


def _count_anchors(batches):
    for big in batches:
        for b in C.slices(big, "text"):
            grams = [g for g, _, _, _ in stretches(*C.text_buffer(b.column("text")))]
            if grams:
                key, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["gram", "n"])


def _emit(repeated):
    """Stretches with their bytes; with `repeated`, a broadcast sorted array, only those whose anchor is in it."""

    def run(batches):
        for big in batches:
            for b in C.slices(big, "text"):
                raw, offsets = C.text_buffer(b.column("text"))
                k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
                for gram, whole, lo, count in stretches(raw, offsets):
                    if repeated is not None:
                        known = repeated.value
                        here = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
                        gram, whole, lo, count = gram[here], whole[here], lo[here], count[here]
                    if not len(gram):
                        continue
                    row = np.searchsorted(offsets, lo, side="right") - 1
                    size = count + LENGTH - 1
                    ends = np.cumsum(size)
                    flat = raw[np.arange(int(ends[-1])) + np.repeat(lo - (ends - size), size)]
                    text = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(whole), pa.array(k1[row]), pa.array(k2[row]), pa.array((lo - offsets[row]).astype(np.int64)), pa.array(count.astype(np.int32)), text],
                        ["gram", "stretch", "k1", "k2", "lo", "cnt", "t"],
                    )

    return run


def _spans(flags: np.ndarray, bounds: np.ndarray):
    """Runs of true flags within bounds, as (group, from, to)."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(flags & (np.append(True, ~flags[:-1]) | edge[:-1]))
    end = np.flatnonzero(flags & (np.append(~flags[1:], True) | edge[1:])) + 1
    group = np.searchsorted(bounds, begin, side="right") - 1
    return group, begin - bounds[group], end - bounds[group]


def _resolve(batches):
    for t, at in C.groups(batches, ["gram"], 2048):
        size = np.array([len(x.as_buffer()) for x in t.column("t")], np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        a = 0
        while a < len(at) - 1:
            b = max(a + 1, int(np.searchsorted(total[at], total[at[a]] + CHUNK, "right")) - 1)
            part = t.slice(at[a], at[b] - at[a])
            text = np.frombuffer(b"".join(x.as_buffer() for x in part.column("t")), np.uint8)
            begin = total[at[a] : at[b] + 1] - total[at[a]]
            count = part.column("cnt").to_numpy().astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(count)))
            starts = np.arange(int(bounds[-1])) + np.repeat(begin[:-1] - bounds[:-1], count)
            flags = repeated_starts(text, starts, np.repeat(part.column("n").to_numpy(), count))
            g, lo, hi = _spans(flags, bounds)
            if len(g):
                yield pa.RecordBatch.from_arrays([part.column("stretch").to_numpy()[g], part.column("bytes").to_numpy()[g], pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["stretch", "bytes", "i", "j"])
            a = b


def _strings(batches):
    """Hashes of each string of hot groups' stretches, read forwards and backwards."""
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            size = np.array([len(x.as_buffer()) for x in part.column("t")], np.int64)
            begin = np.cumsum(size) - size
            text = np.frombuffer(b"".join(x.as_buffer() for x in part.column("t")), np.uint8)
            prefix, back = C.prefix_hash(text), C.prefix_hash(text[::-1])
            count = part.column("cnt").to_numpy().astype(np.int64)
            who = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            starts = begin[who] + place
            last = len(text) - starts
            names = pa.array(C.span_hash(prefix, starts, starts + LENGTH).view(np.int64)), pa.array(C.span_hash(back, last - LENGTH, last).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("stretch").take(pa.array(who)), part.column("bytes").take(pa.array(who)), pa.array(place.astype(np.int32)), *names], ["stretch", "bytes", "i", "string", "back"])


def _cut(names: list[str]):
    def run(batches):
        for big in batches:
            for b in C.slices(big, "text"):
                raw, offsets = C.text_buffer(b.column("text"))
                removed, spans, digest = [], [], []
                for i, found in enumerate(b.column("spans").to_pylist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if not found:
                        removed.append(0)
                        spans.append(0)
                        digest.append(hashlib.sha256(text.tobytes()).hexdigest())
                        continue
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, [x["i"] for x in found], 1)
                    np.add.at(step, [x["j"] for x in found], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                    digest.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    long = rows.where(F.octet_length("text") >= LENGTH)
    counted = long.select("text").mapInArrow(_count_anchors, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    repeated = C.materialise(counted.where("n > 1").select("gram"), "suffix-anchors")
    schema = "gram long, stretch long, k1 long, k2 long, lo long, cnt int, t binary"
    if (n := repeated.count()) == 0:
        found = spark.createDataFrame([], schema)
    elif n <= MOST_BROADCAST:
        known = spark.sparkContext.broadcast(np.sort(repeated.toArrow()["gram"].to_numpy()))
        found = long.select("text", "k1", "k2").mapInArrow(_emit(known), schema)
    else:
        found = long.select("text", "k1", "k2").mapInArrow(_emit(None), schema).join(repeated, "gram", "left_semi")
    found = C.materialise(found.withColumn("bytes", F.xxhash64("t", "cnt")), "suffix-stretches")
    C.discard(repeated)

    kinds = C.materialise(found.groupBy("gram", *NAME).agg(F.count("*").alias("n")), "suffix-kinds")
    groups = kinds.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    mixed = groups.where("m > 1 and least = 1")  # others are settled by their counts
    asked = kinds.join(mixed.select("gram", "m"), "gram").select(*NAME, "n", "m").dropDuplicates(NAME)
    # one row a stretch before the join, so that a frequent stretch never meets in a task
    one = found.select("gram", *NAME, "cnt", "t").dropDuplicates(NAME).join(asked, NAME)
    one = C.materialise(one, "suffix-mixed")
    calm = one.where(F.col("m") <= HOT).select("gram", *NAME, "cnt", "n", "t").repartition("gram").sortWithinPartitions("gram")
    resolved = calm.mapInArrow(_resolve, "stretch long, bytes long, i int, j int")
    strings = one.where(F.col("m") > HOT).select(*NAME, "cnt", "t").mapInArrow(_strings, "stretch long, bytes long, i int, string long, back long")
    twice = strings.groupBy("string", "back").agg(F.count("*").alias("c")).where("c > 1").select("string", "back")
    hot = strings.join(twice, ["string", "back"], "left_semi").select(*NAME, "i", (F.col("i") + 1).alias("j"))
    settled = kinds.where("n > 1").select(*NAME, F.lit(0).alias("i"), F.lit(1 << 30).alias("j"))
    marks = C.materialise(resolved.unionByName(hot).unionByName(settled), "suffix-marks")

    # one row a stretch: its runs (no more than its strings) and how often it occurs
    runs = marks.groupBy(*NAME).agg(F.collect_list(F.struct("i", "j")).alias("runs"))
    runs = runs.join(kinds.groupBy(*NAME).agg(F.sum("n").alias("n")), NAME)
    placed = C.materialise(found.select(*NAME, "k1", "k2", "lo", "cnt").dropDuplicates(["k1", "k2", "lo"]), "suffix-places")
    stops = (
        C.join_hot(placed, C.materialise(runs, "suffix-runs"), NAME, "n", max(found.count(), 1))
        .select("k1", "k2", "lo", "cnt", F.inline("runs"))
        .select("k1", "k2", F.struct((F.col("lo") + F.col("i")).cast("int").alias("i"), (F.col("lo") + F.least("j", "cnt") - 1 + LENGTH).cast("int").alias("j")).alias("s"))
    )
    spans = stops.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))  # of one text
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    spans = C.materialise(spans.join(copies, ["k1", "k2"]), "suffix-spans")
    C.discard(found, kinds, one, marks)
    joined = C.join_hot(rows, spans, ["k1", "k2"], "n", max(rows.count(), 1), "left").select("id", "text", "spans")
    names = [doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(_cut(names), f"`{doc_id}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
