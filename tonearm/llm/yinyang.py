"""Centroid clustering by Yinyang grouping, with exact integer distances.

Vectors become integers, floor(SCALE * x). Centroids start as the kept vectors with the smallest hashed ids. They are
clustered into groups once; each vector carries its cluster, an upper bound of the distance to its centroid and one lower
bound a group. When centroids move, the bounds move with them: a vector whose upper bound is below all its lower bounds
is done (global filter), else only groups whose bound it reaches are looked at (group filter), and in these only centroids
that their own movement lets come nearer are compared exactly. Bounds are widened by more than their rounding, and
only strictly farther centroids are skipped, so ties go to the smaller number as in the plain method.

Each round is one pass that writes the vectors with their bounds to the shared folder, with each task's sums by cluster beside
them; the driver gets k * dimension totals and makes the exact quotients. A lost executor costs its tasks of the present round.

Defined cases: vectors that are null, of another length or with null or non-finite components are left out; a null id
is kept and clustered, but starts no centroid; rows with equal ids are rows of their own (as starts they tie, and go by
their components); with fewer vectors than k each starts one; an empty table gives no rows; other columns aren't read. Components
beyond 2**22 are compared with Python's integers, slower but exact; scaled beyond 2**63 they stay at its end; a
distance or sum beyond 2**63 is null.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SCALE, CLUSTERS, ROUNDS, DIM = 1024, 8, 10, 64
#: Centroids a group.
GROUP = 4
#: Up to here sums of squared differences are exact in doubles (64 components; fewer for more).
EXACT = 1 << 22
SLACK = 1e-12
ROWS = 8192


def integers(frame: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the kept vectors as integers."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = frame.where(F.col(embedding).isNotNull() & (F.size(embedding) == dim)).where(fine)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def start(vectors: DataFrame, k: int, seed: str = "3:") -> list[list[int]]:
    """The k vectors with the smallest hashed ids."""
    named = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    return [list(r["v"]) for r in named.orderBy("h", "v").select("v").limit(k).collect()]


def grouped(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """Group of each centroid: a few rounds of plain clustering of the k centroids."""
    x = centroids.astype(np.float64)
    t = -(-len(x) // size)
    at = x[np.linspace(0, len(x) - 1, t).astype(int)] if t else x
    group = np.zeros(len(x), int)
    for _ in range(5 if t > 1 else 0):
        group = ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)
        at = np.array([x[group == j].mean(0) if (group == j).any() else at[j] for j in range(t)])
    return np.unique(group, return_inverse=True)[1]


class Model:
    """Centroids, their groups and how far each moved last; `whole`: doubles are exact."""

    def __init__(self, centroids: list[list[int]], group: np.ndarray, whole: bool, before: list[list[int]] | None = None):
        self.c = np.array(centroids, np.float64 if whole else object).reshape(len(centroids), -1)
        self.group, self.whole = group, whole
        self.groups = int(group.max()) + 1 if len(group) else 0
        moved = [sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(centroids, before or centroids)]
        self.drift = np.sqrt(np.array(moved, np.float64)) * (1 + SLACK)
        self.most = np.array([self.drift[group == j].max() for j in range(self.groups)])
        self.cc = (self.c * self.c).sum(1)

    def squares(self, x: np.ndarray, k) -> np.ndarray:
        """Exact squared distances of rows to centroids k."""
        c = self.c[k]
        if self.whole:
            return (x * x).sum(1)[:, None] + self.cc[k][None] - 2 * (x @ c.T)
        return np.array([[((r - y) ** 2).sum() for y in c] for r in x], object).reshape(len(x), len(c))

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        d = x - self.c[cluster]
        return (d * d).sum(1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def first(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by comparing all."""
    d = m.squares(x, np.arange(len(m.c)))
    cluster = d.argmin(1) if m.whole else np.array([min(range(len(r)), key=r.__getitem__) for r in d], int)
    rows = np.arange(len(x))
    upper, low = above(d[rows, cluster]), below(d)
    low[rows, cluster] = np.inf
    lower = np.stack([low[:, m.group == j].min(1) for j in range(m.groups)], 1)
    return cluster, upper, lower


def again(m: Model, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same by the bounds, after the centroids moved; and how many distances it took."""
    upper = (upper + m.drift[cluster]) * (1 + SLACK)
    before = lower
    lower = lower - m.most[None]
    lower -= SLACK * (np.abs(np.where(np.isinf(before), 0, before)) + m.most[None])
    cluster, work = cluster.copy(), 0
    go = np.flatnonzero(upper >= lower.min(1))  # global filter
    if len(go):
        own = m.own(x[go], cluster[go])
        work += len(go)
        upper[go] = above(own)
        near = upper[go] >= lower[go].min(1)
        go, own = go[near], own[near]
    if not len(go):
        return cluster, upper, lower, work
    best, who, old = own.copy(), cluster[go].copy(), cluster[go].copy()
    bound = np.full((len(go), len(m.c)), np.inf)  # lower bounds of the centroids looked at, or skipped one by one
    for j in range(m.groups):
        look = lower[go, j] <= upper[go]  # group filter
        if not look.any():
            continue
        for k in np.flatnonzero(m.group == j).tolist():
            r = np.flatnonzero(look & (old != k))
            low = before[go[r], j] - m.drift[k]
            low -= SLACK * (np.abs(np.where(np.isinf(low), 0, low)) + m.drift[k])
            skip = low > above(best[r])
            bound[r[skip], k] = low[skip]
            r = r[~skip]
            if not len(r):
                continue
            d = m.squares(x[go[r]], [k])[:, 0]
            work += len(r)
            bound[r, k] = below(d)
            better = (d < best[r]) | ((d == best[r]) & (k < who[r]))
            best[r[better]], who[r[better]] = d[better], k
    bound[np.arange(len(go)), old] = below(own)
    bound[np.arange(len(go)), who] = np.inf
    for j in range(m.groups):
        looked = (lower[go, j] <= upper[go]) | (m.group[old] == j) & (old != who)
        low = bound[:, m.group == j].min(1)
        unseen = lower[go, j] > upper[go]  # its group's bound still holds for all but the old centroid
        lower[go[looked], j] = np.where(unseen, np.minimum(low, lower[go, j]), low)[looked]
    cluster[go], upper[go] = who, above(best)
    return cluster, upper, lower, work


STATE = "v array<bigint>, cluster int, upper double, lower array<double>, distance bigint, n bigint, sums array<decimal(38,0)>"


def assign(state: DataFrame, model, last: bool) -> DataFrame:
    """One pass: vectors with their new cluster and bounds, and a row a task and cluster with the sums. `model`: a broadcast Model."""
    known = "cluster" in state.columns
    columns = ["vec_id", "v", *(["cluster", "upper", "lower"] if known else [])]
    schema = T.StructType([state.schema["vec_id"], *T._parse_datatype_string(STATE).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        m = model.value
        k, dim = m.c.shape
        sums, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for big in batches:
            for a in range(0, big.num_rows, ROWS):
                b = big.slice(a, ROWS)
                v = b.column("v").flatten().to_numpy().reshape(-1, dim)
                x = v.astype(np.float64) if m.whole else v.astype(object)
                if known:
                    lower = b.column("lower").flatten().to_numpy().reshape(-1, m.groups)
                    cluster, upper, lower, _ = again(m, x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), lower)
                else:
                    cluster, upper, lower = first(m, x)
                distance = [int(d) if d < 1 << 63 else None for d in m.own(x, cluster)] if last else None
                for c in np.unique(cluster).tolist():
                    mine = x[cluster == c]
                    count[c] += len(mine)
                    sums[c] += np.array([int(s) for s in mine.sum(0)], object)
                n = b.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.groups), pa.array(lower.ravel()))
                out = [b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), lists, pa.array(distance, pa.int64()) if last else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, arrow.field("sums").type)]
                yield pa.RecordBatch.from_arrays([o.cast(f.type) for o, f in zip(out, arrow)], schema=arrow)
        some = np.flatnonzero(count)
        if len(some):
            out = {f.name: pa.nulls(len(some), f.type) for f in arrow}
            out["cluster"], out["n"] = pa.array(some.astype(np.int32)), pa.array(count[some])
            out["sums"] = pa.array([[Decimal(s) for s in sums[c]] for c in some.tolist()], arrow.field("sums").type)
            yield pa.RecordBatch.from_arrays([out[f.name] for f in arrow], schema=arrow)

    rows = state.where("n is null") if known else state
    return rows.select(*columns).mapInArrow(run, schema)


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Exact floors of the means; clusters without vectors stay. At most k * dimension totals reach the driver."""
    parts = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    totals = parts.groupBy("cluster", "at").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect()
    out = [list(c) for c in centroids]
    for r in totals:
        out[r["cluster"]][r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3:", group: int = GROUP) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, v, cluster and distance (squared) of each row of integers(), and the final centroids."""
    spark = vectors.sparkSession
    vectors = C.materialise(vectors, "vectors")
    centroids = start(vectors, k, seed)
    none = vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    if not centroids:
        return none, centroids
    most = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(20,0)")), F.abs(F.array_min("v").cast("decimal(20,0)"))))).first()[0]
    whole = int(most) <= EXACT and len(centroids[0]) <= 64
    groups = grouped(np.array(centroids, np.float64), group)
    state, before = vectors, None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Model(centroids, groups, whole, before))
        done = C.materialise(assign(state, shared, turn == rounds), "yinyang")
        C.discard(state)
        shared.destroy()
        state = done
        if turn < rounds:
            before, centroids = centroids, moved(state, centroids)
    return state.where("n is null").select("vec_id", "v", "cluster", "distance"), centroids


def report(spark: SparkSession, frame: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    rows, centroids = cluster(integers(frame), k, rounds)
    fits = lambda n: n if n < 1 << 63 else None
    each = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).where("s is not null").collect()}  # a row a centroid
    facts = [(c, fits(each.get(c, 0)), fits(sum(each.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, C.table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    """The plain method in SQL, a step a round."""
    text = """
WITH x AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0
), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS m
    FROM (SELECT v, sha256('3:' || vec_id) AS h FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)
)"""
    for i in range(rounds + 1):
        text += f""", a{i} AS MATERIALIZED (
    SELECT r, c, d FROM (
        SELECT r, c, CAST(list_sum(list_transform(list_zip(x.v, c{i}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x, c{i}
    ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
        if i < rounds:
            text += f""", c{i + 1} AS MATERIALIZED (
    SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} AS o LEFT JOIN (
        SELECT c, list(q ORDER BY i) AS m FROM (
            SELECT c, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
            FROM (SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x JOIN a{i} USING (r)) GROUP BY c, i
        ) GROUP BY c
    ) AS n ON o.c = n.c
)"""
    return text + f"""
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN c{rounds} AS f ON a{rounds}.c = f.c
"""


ORACLE_SQL = _sql()
