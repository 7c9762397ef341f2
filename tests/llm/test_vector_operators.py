import numpy as np
import pyarrow as pa
import pytest

from tonearm.llm import annsearch, vecdedup
from tonearm.llm import vectors as V


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    rows, centres = [], r.standard_normal((6, 16))
    for i in range(400):
        v = centres[i % 6] + r.standard_normal(16) * (0.25 if i % 3 else 0.5) if i % 2 else r.standard_normal(16)
        rows.append((i, [float(x) for x in v], i % 4))
    rows += [(1000 + i, rows[i][1], 0) for i in range(5)] + [(2000, [2 * x for x in rows[1][1]], 0)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [1.0] * 15 + [None], 0), (3003, [float("nan")] * 16, 0), (3004, [1.0] * 4, 0), (3005, [float("inf")] * 16, 0), (None, rows[0][1], 0), (7, rows[7][1], 1), (3006, [], 0)]
    return rows


def valid(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]


def test_dedup_equals_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(vecdedup, "TILE", 32)
    monkeypatch.setattr(vecdedup, "PART", 50)
    good = valid(clustered)
    x = np.array([np.float32(v).astype(np.float64) for _, v in good])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[near[i]].min()) if near[i].any() else label[i] for i in range(len(ids))])
        for k in set(ids.tolist()):  # rows that share an id are one node
            new[ids == k] = new[ids == k].min()
        if (new == label).all():
            break
        label = new
    want = sorted((int(i), int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label))
    out = vecdedup.near_duplicates(frame(spark, clustered)).collect()
    assert len(out) == len(clustered)
    bad = {3000, 3001, 3002, 3003, 3004, 3005, 3006, None}
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] not in bad)
    assert got == want
    for r in out:
        if r["vec_id"] in bad:
            assert r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"]


def test_error_bounds_hold():
    r = np.random.default_rng(0)
    for scale in (1e-30, 1.0, 1e30):
        u = V.unit(r.standard_normal((200, 24)) * scale * np.exp(r.standard_normal((200, 24))))
        q, s, e = vecdedup.quantise(u)
        exact, coarse = u @ u.T, (q @ q.T) * s[:, None] * s[None]
        assert (np.abs(exact - coarse) <= e[:, None] + e[None] + 3 * e[:, None] * e[None] + 1e-12).all()


def test_search_recall_and_scores(spark, clustered):
    table = frame(spark, clustered)
    out = annsearch.search(table, table.where("vec_id % 50 = 0")).toPandas()
    good = {i: v for i, v in valid(clustered)}
    ids = np.array(sorted(good))
    x = np.array([np.float32(good[i]).astype(np.float64) for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = [i for i in ids if i % 50 == 0]
    hit = 0
    for q in asked:
        s = u @ u[np.searchsorted(ids, q)]
        s[ids == q] = -3
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = out[out.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1)) and list(mine.score) == sorted(mine.score, reverse=True)
        hit += len(set(best) & set(mine.vec_id))
    assert hit >= 0.9 * 5 * len(asked) and set(out.query_id) == set(asked)


def test_search_recall_on_documents_of_the_driver(spark):
    sf = "/root/testdata/sf0.1"
    out = annsearch.query(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.array(e.embedding.tolist(), np.float64)
    u, ids = x / np.linalg.norm(x, axis=1)[:, None], e.vec_id.to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -3
    best = ids[np.argsort(-s, axis=1)[:, :5]]
    got = {k: set(g.vec_id) for k, g in out.groupby("query_id")}
    assert np.mean([len(set(b) & got.get(ids[a], set())) / 5 for a, b in zip(asked, best)]) >= 0.9


def test_search_few_and_none(spark):
    few = frame(spark, [(0, [1.0, 0.0], 0), (50, [-1.0, 0.0], 0), (1, [0.0, 1.0], 0)])
    out = annsearch.search(few, few.where("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    empty = few.limit(0)
    assert annsearch.search(empty, empty).count() == 0 and vecdedup.near_duplicates(empty).count() == 0
    assert annsearch.search(few, empty).count() == 0


def test_vectors_of_rarer_lengths_meet_their_own_kind(spark, clustered):
    extra = [(4000, [1.0, 2.0], 0), (4001, [2.0, 4.0], 0), (4050, [1.0, -2.0], 0), (4002, [1.0, 2.0, 0.0], 0), (4100, [1.0, 2.0, 0.1], 0), (4150, [5.0], 0)]
    table = frame(spark, clustered + extra)
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.near_duplicates(table).collect() if r["vec_id"] in {e[0] for e in extra}}
    assert out == {4000: (1, 4000), 4001: (1, 4000), 4050: (0, 4050), 4002: (1, 4002), 4100: (1, 4002), 4150: (0, 4150)}
    found = annsearch.search(table, table.where("vec_id % 50 = 0 and vec_id >= 4000")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(4000, 1, 4001), (4000, 2, 4050), (4050, 1, 4000), (4050, 2, 4001), (4100, 1, 4002)]


def test_products_are_exact_for_many_components():
    r = np.random.default_rng(4)
    for dim in (1024, 1025, 4096):
        q, p = (np.where(r.random((5, dim)) < 0.99, 127, -127).astype(np.int8) for _ in range(2))
        assert (vecdedup.products(q.astype(np.float32), p.astype(np.float32)) == q.astype(np.int64) @ p.astype(np.int64).T).all()


def test_clashing_columns_and_doubles(spark, clustered):
    from pyspark.sql import functions as F

    table = frame(spark, clustered[:120])
    odd = table.select(F.col("vec_id").cast("int"), F.col("embedding").cast("array<double>"), *[F.lit(1).alias(n) for n in ("id", "v", "kept", "rank", "score", "tile", "key", "component_id", "n")])
    pick = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert pick(vecdedup.near_duplicates(odd), "vec_id", "n_links", "component_id") == pick(vecdedup.near_duplicates(table), "vec_id", "n_links", "component_id")
    assert pick(annsearch.search(odd, odd.where("vec_id % 50 = 0")), "query_id", "rank") == pick(annsearch.search(table, table.where("vec_id % 50 = 0")), "query_id", "rank")


def test_search_visits_few_rows_of_clustered_vectors():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 64))[r.integers(0, 400, 8192)] + 0.35 * r.standard_normal((8192, 64))
    h = annsearch.fit(x, 5, 50_000)
    assert h.recall >= annsearch.TARGET and h.visited < 0.2
    more = annsearch.fit(x, 5, 50_000_000)
    assert more.visited <= h.visited


def test_search_of_many_clustered_vectors_against_brute_force(spark, monkeypatch):
    """All queries over 50,000 rows: recall, and the rows that hashing visits."""
    r = np.random.default_rng(2)
    x = (r.standard_normal((400, 64))[r.integers(0, 400, 50_000)] + 0.35 * r.standard_normal((50_000, 64))).astype(np.float32)
    fits, fit = [], annsearch.fit
    monkeypatch.setattr(annsearch, "fit", lambda *a: fits.append(fit(*a)) or fits[-1])
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": lists}))
    got = annsearch.search(table, table.where("vec_id % 50 = 0")).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 50_000, 50):
        near = u @ u[q]
        near[q] = -2
        hits += len(set(np.argpartition(-near, 5)[:5].tolist()) & set(got.vec_id[got.query_id == q]))
    assert len(got) == 5000 and hits >= 0.9 * 5000 and fits[0].visited < 0.2


def test_search_never_meets_more_than_a_scan_where_nothing_prunes():
    x = np.random.default_rng(3).standard_normal((4000, 64))
    h = annsearch.fit(x, 5, 4000)
    assert h is None or (h.visited < 1 and h.tables == 1)


def test_search_of_repeated_ids_takes_the_same_row(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.1], 0)]
    out = [sorted(map(tuple, annsearch.search(t, t.where("vec_id = 0")).select("rank", "vec_id", "score").collect())) for t in (frame(spark, rows), frame(spark, rows[::-1]).repartition(3))]
    assert out[0] == out[1] and [r[1] for r in out[0]] == [1, 2]


def test_search_answers_exactly_where_hashing_cannot(spark, clustered, monkeypatch):
    monkeypatch.setattr(annsearch, "TARGET", 2.0)
    table = frame(spark, clustered)
    good = [(i, v / np.linalg.norm(v)) for i, v in valid(clustered)]
    for r in annsearch.search(table, table.where("vec_id = 50")).where("rank = 1").collect():
        mine = next(v for i, v in good if i == 50)
        assert abs(r["score"] - max(float(mine @ v) for i, v in good if i != 50)) < 1e-6
