"""Approximate nearest neighbours by multiprobe p-stable hashing.

h(x) = floor((a.x + b) / w) with Gaussian a, several of them a table, one or more tables, over unit vectors. A query
visits perturbed buckets of each table in the order of their estimated success (the sum of squared distances to
the slot borders that a perturbation crosses), candidates of all tables are merged and ranked by exact cosine in
double precision. Every row is indexed. Buckets are dealt in blocks of bounded size; a block keeps a query's best k.

The number of tables, the hash functions a table, the slot width and the number of probes are fitted on a bounded sample: of all choices whose
recall there, against brute force, reaches TARGET, the one with the least expected cost on the whole table is taken (rows
visited, and probes at PROBE_COST rows each). So more functions, hence smaller buckets, are taken as rows
grow. Where hashing can't answer, rows are compared exactly, by blocks: if no choice reaches TARGET, for queries that found
fewer than k candidates although there are more, and for vectors of another length than most (each with its own length).

Defined cases: vectors that are null, empty, zero, hold null or non-finite components take no part, neither do rows
with a null id; vectors of different lengths aren't compared; a query finds all candidates if they are fewer than k; ties go
to the smaller id; of rows with equal ids one takes part, that whose vector's bytes are the smallest; other columns are not
read. The rank starts from 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: Numbers of tables to choose from; with one, buckets are disjoint and no row is met twice.
TABLES = (1, 2, 4)
#: (functions a table, slot width in standard deviations of the projections) to choose from.
CHOICES = ((1, 2.0), (2, 1.3), (2, 2.0), (2, 2.6), (3, 2.0), (4, 1.3), (4, 2.0), (8, 1.3), (8, 2.0), (8, 3.0), (12, 1.3), (12, 2.0), (12, 3.0), (16, 2.0), (16, 3.0), (16, 4.0))
SAMPLE, SAMPLE_QUERIES = 8192, 128
TARGET = 0.96
MOST_PROBES = 512
#: Cost of a probe in candidates: it moves a row with its vector through a shuffle, a candidate is a product in a block.
PROBE_COST = 64
BLOCK = 4096


def perturbations(most: int, functions: int) -> np.ndarray:
    """Shifts (-1, 0, 1) of sorted border distances in falling expected success, as in query-directed probing.

    Entry j < functions stands for the j-th smallest border distance, entry 2 * functions - 1 - j for the
    other border of the same function. Rows hold 0 / 1 for the borders crossed; the first row crosses none.
    """
    n = 2 * functions
    j = np.arange(1, functions + 1)
    expected = np.concatenate((j * (j + 1) / (4.0 * (functions + 1) * (functions + 2)), 1 - np.arange(functions, 0, -1) / (functions + 1.0) + np.arange(functions, 0, -1) * (np.arange(functions, 0, -1) + 1) / (4.0 * (functions + 1) * (functions + 2))))
    out = [np.zeros(n, np.int8)]
    heap = [(expected[0], (0,))]
    while heap and len(out) < most:
        score, chosen = heapq.heappop(heap)
        if all(n - 1 - c not in chosen for c in chosen):
            row = np.zeros(n, np.int8)
            row[list(chosen)] = 1
            out.append(row)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*chosen, last + 1)))
    return np.array(out)


class Hashing:
    def __init__(self, dim: int, sample: np.ndarray, functions: int, slot: float, tables: int = max(TABLES), seed: int = 5):
        r = np.random.default_rng(seed)
        self.functions, self.tables = functions, tables
        self.a = r.standard_normal((dim, max(TABLES) * functions))
        spread = float((sample @ self.a).std()) if len(sample) else 1.0
        self.w = slot * max(spread, 1e-9)
        self.b = r.uniform(0, self.w, max(TABLES) * functions)
        self.a, self.b = self.a[:, : tables * functions], self.b[: tables * functions]  # the first of them
        self.shifts = perturbations(MOST_PROBES, functions)
        self.probes = len(self.shifts)

    def slots(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of unit vectors (rows x tables x functions) and the places within them, 0 to 1."""
        y = (u @ self.a + self.b) / self.w
        slot = np.floor(y)
        return slot.astype(np.int64).reshape(-1, self.tables, self.functions), (y - slot).reshape(-1, self.tables, self.functions)

    def keys(self, slot: np.ndarray) -> np.ndarray:
        h = np.zeros(slot.shape[:-1], C.U64)
        for k in range(self.functions):
            h = C.mix(h * C.U64(C.MULT) + slot[..., k].astype(np.int64).view(C.U64) + C.U64(1))
        return h.view(np.int64)

    def visits(self, u: np.ndarray) -> np.ndarray:
        """Bucket keys that each row visits, rows x tables x probes, best first."""
        m = self.functions
        slot, place = self.slots(u)
        shifts = self.shifts[: self.probes]
        border = np.concatenate((place, 1 - place), axis=-1)  # distance to the lower and the upper border
        step = np.concatenate((np.full(m, -1), np.ones(m, int)))
        order = np.argsort(border, axis=-1, kind="stable")  # place p and 1 - p mirror each other in this order
        out = np.empty((len(u), self.tables, len(shifts)), np.int64)
        for t in range(self.tables):
            o = order[:, t]
            move = np.zeros((len(u), len(shifts), m), np.int64)
            for c in range(2 * m):
                hit = shifts[:, c] == 1
                if hit.any():
                    f = o[:, c] % m
                    move[np.arange(len(u))[:, None], np.flatnonzero(hit)[None], f[:, None]] += step[o[:, c]][:, None]
            out[:, t] = self.keys(slot[:, t, None] + move)
        return out


def fit(sample: np.ndarray, k: int, total: int) -> Hashing | None:
    """The cheapest hashing whose recall on the sample reaches TARGET; None if none does.

    On a table larger than the sample neighbours are nearer, so its recall is no less than the sample's.
    """
    if len(sample) < 2:
        return None
    u = V.unit(sample)
    queries = u[:SAMPLE_QUERIES]
    near = queries @ u.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(u) - 1)]
    found, least = None, np.inf
    for functions, slot in CHOICES:
        h = Hashing(u.shape[1], u, functions, slot)
        own = h.keys(h.slots(u)[0])  # rows x tables
        visited = h.visits(queries)
        reached = np.full(best.shape, h.probes)
        rows = np.zeros(h.probes)
        for t in range(h.tables):
            same = visited[:, t, None, :] == own[best, t][:, :, None]
            reached = np.minimum(reached, np.where(same.any(-1), same.argmax(-1), h.probes))
            bucket, n = np.unique(own[:, t], return_counts=True)
            spot = np.minimum(np.searchsorted(bucket, visited[:, t]), len(bucket) - 1)
            rows += np.where(bucket[spot] == visited[:, t], n[spot], 0).mean(0)
            if t + 1 not in TABLES:
                continue
            recall = np.cumsum(np.bincount(reached.ravel(), minlength=h.probes + 1)[: h.probes]) / reached.size
            enough = int(np.searchsorted(recall, TARGET)) + 1
            if enough > h.probes:
                continue
            visits = float(rows[:enough].sum() / len(u))
            cost = visits * total + PROBE_COST * (t + 1) * enough
            if cost < least:
                found, least = Hashing(u.shape[1], u, functions, slot, t + 1), cost
                found.probes, found.recall, found.visited = enough, float(recall[enough - 1]), visits
    return found


def _rank(k: int, kind: str):
    width = np.dtype(kind).itemsize

    def run(batches):
        for t, at in C.groups(batches, ["tab", "key", "i", "j"], 2048):
            ids, asks = t.column("id").to_numpy(), np.asarray(t.column("asks"))
            size = V.sizes(t.column("v"))
            x = u = None
            if size.min() == size.max():
                x = V.unpack(t.column("v"), int(size[0]) // width, kind)
                u = V.unit(x)
            out = []
            for g0, g1 in zip(at[:-1].tolist(), at[1:].tolist()):
                q, c = np.flatnonzero(asks[g0:g1]), np.flatnonzero(~asks[g0:g1])
                if not len(q) or not len(c):
                    continue
                xs = V.unpack(t.column("v").slice(g0, g1 - g0), int(size[g0]) // width, kind) if x is None else x[g0:g1]
                us, who = V.unit(xs) if u is None else u[g0:g1], ids[g0:g1]
                near = us[q] @ us[c].T
                near[who[q][:, None] == who[c][None]] = -3
                if len(c) > k:
                    least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k] - 1e-9
                else:
                    least = np.full(len(q), -2.0)
                a, b = np.nonzero(near >= np.maximum(least, -2)[:, None])
                score = V.cosines(xs[q[a]], xs[c[b]])
                order = np.lexsort((who[c[b]], -score, a))
                a, b, score = a[order], b[order], score[order]
                _, first = C.runs(a)
                keep = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
                out.append((who[q[a[keep]]], who[c[b[keep]]], score[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in range(3)], ["query_id", "vec_id", "score"])

    return run


def _meet(places: DataFrame, visits: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id and score of the best k rows of each block that a query meets.

    places (tab, key, id, v) and visits (tab, key, id) meet by bucket, in blocks of BLOCK rows and BLOCK visits.
    """
    sizes = places.groupBy("tab", "key").agg(F.count("*").alias("n"))
    waiting = visits.groupBy("tab", "key").agg(F.count("*").alias("m"))
    both = C.materialise(sizes.join(waiting, ["tab", "key"]), "ann-buckets")  # buckets with rows and visits
    both = both.select("tab", "key", "n", "m", F.ceil(F.col("n") / BLOCK).alias("ni"), F.ceil(F.col("m") / BLOCK).alias("mi"))
    n_index, n_visits = places.count(), visits.count()
    part = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    stored = C.join_hot(places, both, ["tab", "key"], "n", n_index).withColumn("i", part("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mi").cast("int") - 1)))
    coming = C.join_hot(visits, both, ["tab", "key"], "m", n_visits).withColumn("j", part("mi")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni").cast("int") - 1)))
    coming = coming.join(asked, "id")
    columns = ["tab", "key", "i", "j", "asks", "id", "v"]
    blocks = stored.withColumn("asks", F.lit(False)).select(*columns).unionByName(coming.withColumn("asks", F.lit(True)).select(*columns))
    return blocks.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j").mapInArrow(_rank(k, kind), "query_id long, vec_id long, score double")


def _exactly(live: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """The same against all rows of a query's length: one bucket a length."""
    places = live.select(F.lit(-1).alias("tab"), F.length("v").cast("long").alias("key"), "id", "v")
    visits = asked.select(F.lit(-1).alias("tab"), F.length("v").cast("long").alias("key"), "id")
    return _meet(places, visits, asked, k, kind)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of index found for each row of queries; a query's own id is left out."""
    spark = index.sparkSession
    kinds = {V.kind_of(index, embedding), V.kind_of(queries, embedding)}
    kind = kinds.pop() if len(kinds) == 1 else "<f8"
    rows = V.packed(index, vec_id, embedding, kind)
    one = lambda r: r.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    live, asked = one(rows), one(V.packed(queries, vec_id, embedding, kind))
    usual = V.usual_size(rows) or 0
    dim = usual // np.dtype(kind).itemsize
    most, asked_most = live.where(F.length("v") == usual), asked.where(F.length("v") == usual)
    sample = C.bounded_sample(most, ["id"], SAMPLE).select("v").toArrow()["v"] if usual else []
    hashing = fit(V.unpack(sample, dim, kind), k, most.count()) if len(sample) else None
    if hashing is None:
        return _best(_exactly(live, asked, k, kind), k)
    shared = spark.sparkContext.broadcast(hashing)

    def index_rows(batches):
        h = shared.value
        for b in batches:
            if b.num_rows:
                key = h.keys(h.slots(V.unit(V.unpack(b.column("v"), dim, kind)))[0])
                who = np.repeat(np.arange(b.num_rows), h.tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(h.tables, dtype=np.int32), b.num_rows)), pa.array(key.ravel()), b.column("id").take(pa.array(who)), b.column("v").take(pa.array(who))], ["tab", "key", "id", "v"])

    def query_rows(batches):
        h = shared.value
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                visited = h.visits(V.unit(V.unpack(b.column("v"), dim, kind)))
                who = np.repeat(np.arange(b.num_rows), h.tables * visited.shape[2])
                tab = np.tile(np.repeat(np.arange(h.tables, dtype=np.int32), visited.shape[2]), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(tab), pa.array(visited.ravel()), b.column("id").take(pa.array(who))], ["tab", "key", "id"])

    places = C.materialise(most.mapInArrow(index_rows, "tab int, key long, id long, v binary"), "ann-index")
    visits = C.materialise(asked_most.mapInArrow(query_rows, "tab int, key long, id long"), "ann-visits")
    found = C.materialise(_best(_meet(places, visits, asked_most, k, kind), k), "ann-found")
    C.discard(places, visits)
    # queries of other lengths, and those that found fewer than k although there are more: exactly
    own = asked.join(live.select("id").withColumn("own", F.lit(1)), "id", "left").select("id", F.length("v").alias("size"), F.coalesce("own", F.lit(0)).alias("own"))
    there = live.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("rows"))
    n_found = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("found"))
    short = own.join(F.broadcast(there), "size").join(n_found, "id", "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("rows") - F.col("own"))).select("id")
    rest = C.materialise(asked.join(short, "id", "left_semi"), "ann-rest")
    if rest.isEmpty():
        return found
    again = _best(_exactly(live, rest, k, kind), k)
    return found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    table = C.table(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 50 = 0"))
