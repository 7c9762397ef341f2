"""Embedding near-dedup by int8 tile products with quantisation error bounds.

Equal vectors form a class and go on once, with their number. Each unit vector u is quantised as s * q, q in
int8, and e >= |u - s q| is kept. For two vectors |u.v - s t q.p| <= e + f + 3 e f, so tile products of the int8
values (held in floats, where these sums are exact) tell which pairs may reach the threshold; only these
are recomputed in double precision. Vectors are dealt into cells around sampled pivots; a cell's vectors
meet those of other cells that its angular radius lets reach it (all pairs that can link do), in blocks of bounded
size. A block adds up links by vector and emits a spanning forest of them, never the pairs themselves.

Vectors are compared with those of their own length. Those of another length than the commonest have no pivots: each such
length is a cell of its own. A tile's home rows are copied once for each PART guests that reach its cell, and each guest once for
each tile within its reach; so copies go with the pairs that the radii can't exclude. On vectors without clusters
these are all pairs, and work and copies grow with the square of the rows, which is what comparing all rows costs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are kept, as are rows with a null id (their component is null); ties go to the smaller id; repeated rows
count as other vectors; labels and other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

THRESHOLD = 0.9
#: Vectors of a tile, and of the part of the others that meets it at once.
TILE, PART = 4096, 8192
#: Cells grow with the square root of the vectors, up to so many pivots (broadcast).
MOST_CELLS = 8192
STRIP = 1024
#: Components of which sums of int8 products stay exact in single precision: 1024 * 127 * 127 < 2**24.
EXACT = 1024


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as floats), scales and error bounds of unit vectors."""
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8).astype(np.float32), s, e


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """q @ p.T of int8 values held in floats, exact for any number of components: pieces of EXACT are added in double precision."""
    if q.shape[1] <= EXACT:
        return q @ p.T
    return sum((q[:, k : k + EXACT] @ p[:, k : k + EXACT].T).astype(np.float64) for k in range(0, q.shape[1], EXACT))


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs with cosine >= threshold; with same, x is y and only pairs i < j count."""
    (q, s, e), (p, t, f) = quantise(V.unit(x)), quantise(V.unit(y))
    found_a, found_b = [], []
    for start in range(0, len(y), STRIP):
        stop = min(start + STRIP, len(y))
        first = 0
        last = stop if same else len(x)
        dots = products(q[first:last], p[start:stop])
        # least product with which row i could reach the threshold with any of the strip
        worst_f, worst_t = f[start:stop].max(), t[start:stop].max()
        need = (threshold - e[:last] - worst_f - 3 * e[:last] * worst_f) / (s[:last] * worst_t)
        rows = np.flatnonzero(dots.max(1) >= need)
        if not len(rows):
            continue
        ei, fj = e[rows, None], f[None, start:stop]
        maybe = dots[rows] * (s[rows, None] * t[None, start:stop]) + (ei + fj + 3 * ei * fj) >= threshold
        i, j = np.nonzero(maybe)
        i, j = rows[i], j + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            sure = V.cosines(x[a], y[b]) >= threshold
            found_a.append(a[sure])
            found_b.append(b[sure])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def near_duplicates(frame: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = frame.sparkSession
    kind = V.kind_of(frame, embedding)
    rows = V.packed(frame, vec_id, embedding)
    total = rows.count()
    usual = V.usual_size(rows)
    width = np.dtype(kind).itemsize
    dim = (usual or width) // width
    live = rows.where("id is not null and v is not null")
    classes = C.materialise(live.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    n = classes.count()
    theta = math.acos(min(1.0, max(-1.0, threshold))) + 1e-9

    cells = max(1, min(MOST_CELLS, -(-n // TILE), max(1024, math.isqrt(n))))
    sample = C.bounded_sample(classes.where(F.length("v") == usual), ["rep"], cells).select("v").toArrow()["v"] if n else []
    cells = max(1, len(sample))
    pivots = V.unit(V.unpack(sample, dim, kind)) if len(sample) else np.ones((1, dim))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            size = V.sizes(b.column("v"))
            cell, angle = -size.astype(np.int64), np.zeros(len(size))
            at = np.flatnonzero(size == usual)
            if len(at):
                near = V.unit(V.unpack(b.column("v").take(pa.array(at)), dim, kind)) @ shared.value.T
                cell[at] = near.argmax(1)
                angle[at] = np.arccos(np.clip(near[np.arange(len(at)), cell[at]], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), b.column("n"), pa.array(cell), pa.array(angle)], ["rep", "v", "n", "cell", "angle"])

    homes = C.materialise(classes.mapInArrow(assign, "rep long, v binary, n long, cell long, angle double"), "vector-homes")
    # one row a cell: at most MOST_CELLS, and one for each other length
    stats = sorted((r["cell"], r["r"], r["m"]) for r in homes.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("m")).collect())
    names = np.array([c for c, _, _ in stats], np.int64)
    tiles = np.array([-(-m // TILE) for _, _, m in stats], np.int64)
    first = np.concatenate(([0], np.cumsum(tiles)))[:-1]
    radius = np.full(cells, -10.0)  # of cells with pivots
    place = np.zeros(cells, np.int64)
    for i, (c, r, _) in enumerate(stats):
        if c >= 0:
            radius[c], place[c] = r, i

    def reached(b):
        """(row, number of a cell within reach) of a batch, in pieces; a row's own cell is always among them."""
        cell = b.column("cell").to_numpy()
        odd = np.flatnonzero(cell < 0)
        if len(odd):
            yield odd, np.searchsorted(names, cell[odd])
        at = np.flatnonzero(cell >= 0)
        for k in range(0, len(at), 256):
            who = at[k : k + 256]
            angle = np.arccos(np.clip(V.unit(V.unpack(b.column("v").take(pa.array(who)), dim, kind)) @ shared.value.T, -1, 1))
            reach = angle <= radius[None] + theta + 1e-9
            reach[np.arange(len(who)), cell[who]] = True
            i, c = np.nonzero(reach)
            yield who[i], place[c]

    def count(batches):
        guests = np.zeros(len(names), np.int64)
        for b in batches:
            for _, c in reached(b):
                guests += np.bincount(c, minlength=len(names))
        some = np.flatnonzero(guests)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(guests[some])], ["c", "n"])

    parts = np.ones(len(names), np.int64)
    for r in homes.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row a cell
        parts[r["c"]] = max(1, -(-r["n"] // (2 * PART)))  # a tile meets about half of its cell's guests

    def deal(batches):
        """A row for each block that a vector takes part in: at home in each part of its tile, and as a guest of tiles within reach."""
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column("rep").to_numpy()
            own = np.searchsorted(names, b.column("cell").to_numpy())
            mixed = C.mix(rep.view(C.U64))
            home = first[own] + (mixed % tiles[own].astype(C.U64)).astype(np.int64)

            def rows_of(who, tile, part, guest, b=b, rep=rep):
                take = pa.array(who)
                return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(part), pa.array(np.full(len(who), guest, np.int8)), pa.array(rep[who]), b.column("n").take(take), b.column("v").take(take)], ["tile", "part", "guest", "rep", "n", "v"])

            for at in range(0, len(rep), 256):
                who = np.arange(at, min(at + 256, len(rep)))
                many = parts[own[who]]
                who = np.repeat(who, many)
                yield rows_of(who, home[who], np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many), 0)
            for i, c in reached(b):
                many = tiles[c]
                i, c, tile = np.repeat(i, many), np.repeat(c, many), np.repeat(first[c], many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
                # each pair of tiles meets in one of the two
                there = (tile != home[i]) & np.where((tile + home[i]) % 2 == 0, tile > home[i], tile < home[i])
                i, c, tile = i[there], c[there], tile[there]
                if len(i):
                    yield rows_of(i, tile, ((mixed[i] >> C.U64(32)) % parts[c].astype(C.U64)).astype(np.int64), 1)

    def compare(batches):
        for t, at in C.groups(batches, ["tile", "part"], 1024):
            for g0, g1 in zip(at[:-1].tolist(), at[1:].tolist()):
                s = t.slice(g0, g1 - g0)
                guest, rep, weight = s.column("guest").to_numpy(), s.column("rep").to_numpy(), s.column("n").to_numpy()
                x = V.unpack(s.column("v"), int(V.sizes(s.column("v").slice(0, 1))[0]) // width, kind)  # a tile has one length
                h, g = np.flatnonzero(guest == 0), np.flatnonzero(guest == 1)
                pairs = []
                if len(h) and s.column("part")[0].as_py() == 0:
                    a, b = near_pairs(x[h], x[h], threshold, True)
                    pairs.append((h[a], h[b]))
                if len(h) and len(g):
                    a, b = near_pairs(x[h], x[g], threshold, False)
                    pairs.append((h[a], g[b]))
                a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
                if not len(a):
                    continue
                b = np.concatenate([p[1] for p in pairs])
                links = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
                who = np.flatnonzero(links)
                node, root = V.star_edges(len(rep), a, b)
                up = np.full(len(rep), -1, np.int64)
                up[node] = root
                to = np.where(up[who] >= 0, rep[up[who]], rep[who])
                yield pa.RecordBatch.from_arrays([pa.array(rep[who]), pa.array(to), pa.array(links[who].astype(np.int64))], ["a", "b", "links"])

    blocks = homes.mapInArrow(deal, "tile long, part long, guest tinyint, rep long, n long, v binary")
    met = blocks.repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(compare, "a long, b long, links long")
    met = C.materialise(met, "vector-links")
    found = C.components(met.select("a", "b"))
    counts = met.groupBy("a").agg(F.sum("links").alias("links"))
    label = (
        classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    linked = C.join_hot(live, label, ["v"], "n", max(total, 1)).select("id", "n_links", "component_id")
    alone = rows.where("id is null or v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
