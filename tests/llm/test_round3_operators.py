"""Operators 11 to 13 against plain versions."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import alignment as A
from tonearm.llm import decontamination as D
from tonearm.llm import yinyang as Y

# ------------------------------------------------------------------ 11, centroid clustering


def lloyd(rows, k=8, rounds=10):
    """rows: (vec_id, list of ints). Plain rounds with Python's integers."""
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c[j] for j in range(len(c))]
    found = [(i, *reversed(near(v))) for i, v in rows]
    each = Counter()
    for _, j, d in found:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v) for i, v in rows], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_clusters_equal_plain_rounds(spark, scale):
    """In doubles, and (scale) with integers beyond what doubles hold."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 64))
    x = (centres[r.integers(0, 12, 300)] + 0.4 * r.standard_normal((300, 64))) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    whole = [(i, [int(np.floor(np.float64(np.float32(e)) * 1024)) for e in v]) for i, v in rows]
    got = sorted(map(tuple, Y.report(spark, vectors(spark, rows).repartition(3)).collect()), key=str)
    assert got == lloyd(whole)


def test_clusters_with_ties_and_repeats(spark):
    """Few distinct integer vectors: many equal distances, equal rows, and clusters that stay empty."""
    r = random.Random(7)
    pool = [[r.choice([-1, 0, 1]) / 1024 for _ in range(64)] for _ in range(5)]
    rows = [(i % 40, r.choice(pool)) for i in range(120)]
    whole = [(i, [round(e * 1024) for e in v]) for i, v in rows]
    assert sorted(map(tuple, Y.report(spark, vectors(spark, rows, "double")).collect()), key=str) == lloyd(whole)


def test_vectors_that_are_left_out(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, []), (4, [0.5] * 63), (5, [None] + good[1:]), (6, [float("nan")] + good[1:]), (7, [float("inf")] + good[1:]), (None, good), (8, [0.0] * 64), (1, good)]
    got = Y.report(spark, vectors(spark, rows).withColumn("Cluster", F.lit("x"))).collect()
    assert sorted(str(x["vec_id"]) for x in got) == ["1", "1", "8", "None"]
    assert Y.report(spark, vectors(spark, rows[1:4])).collect() == []
    huge = Y.report(spark, vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)])).collect()  # beyond long: the ends
    assert len(huge) == 2 and {x["distance"] for x in huge} == {0}


def test_bounds_save_distances():
    """The bounds skip work and change nothing."""
    r = np.random.default_rng(1)
    at = r.integers(-900, 900, (20, 64))
    x = (at[r.integers(0, 20, 2000)] + r.integers(-40, 40, (2000, 64))).astype(np.float64)
    c = [x[i * 100].astype(int).tolist() for i in range(20)]
    group = Y.grouped(np.array(c, float))
    m = Y.Model(c, group, True)
    cluster, upper, lower = Y.first(m, x)
    total = 0
    for _ in range(8):
        moved = [[int(s) // int(n) for s in x[cluster == j].sum(0)] if (n := (cluster == j).sum()) else c[j] for j in range(20)]
        m, c = Y.Model(moved, group, True, c), moved
        cluster, upper, lower, work = Y.again(m, x, cluster, upper, lower)
        plain = m.squares(x, np.arange(20))
        assert np.array_equal(cluster, plain.argmin(1))
        total += work
    assert total < 0.5 * 8 * 20 * len(x)


# ------------------------------------------------------------------ 12, alignment


def aligned(rows):
    """Spans compared one by one, counts in a dict."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A.A_FILE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=A.B_FILE)
    shown = {v: k for k, v in A.byte_symbols().items()}
    assert sorted(shown) == list(range(256))
    symbols = A.byte_symbols()
    docs = []
    for i, text in rows:
        docs.append((i, [], [], []))
        if not text:
            continue
        e, b = t.encode(" " + text, add_special_tokens=False), sp.encode(text)
        bytes_a = [bytes(symbols[c] for c in k) for k in e.tokens]
        bytes_b = [bytes([int(sp.id_to_piece(p)[1:-1], 16)]) if sp.is_byte(p) else sp.id_to_piece(p).replace("▁", " ").encode() for p in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        owner = [j for j, x in enumerate(bytes_b) for _ in x]
        groups, links, at, end_b, j, ga, gb = [], [], 0, 0, 0, [], []
        for n, (a, x) in enumerate(zip(e.ids, bytes_a)):
            links += [(a, b[o]) for o in sorted(set(owner[at : at + len(x)]))]
            at += len(x)
            ga.append(a)
            while end_b < at:
                end_b += len(bytes_b[j])
                gb.append(b[j])
                j += 1
            if end_b == at:
                groups.append((ga, gb))
                ga, gb = [], []
        docs[-1] = (i, e.ids, b, groups, links)
    docs = [d if len(d) == 5 else (*d, []) for d in docs]
    count = Counter(p for *_, links in docs for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted(((i, len(a), len(b), len(g), len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), digest(g)) for i, a, b, g, x in docs), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_a_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.query(spark, sf).select(COLUMNS).collect()), key=str) == aligned(rows)


def test_alignment_of_odd_texts(spark, clashing, none):
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect() if r["doc_id"] not in (7, 8)]
    rows += [(20, "a▁b"), (21, "  \n x <|endoftext|> </s> <0x41>"), (22, "é" * 300), (22, "x" * 70_000 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("x"))
    got = A.alignment(docs, outputs=("ids_a", "group_b", "groups_sha256"), block=500)  # several blocks a task
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == aligned(rows)
    assert got.where("n_a > 0 and (size(ids_a) <> n_a or array_max(group_b) + 1 <> n_groups)").count() == 0
    assert A.alignment(none).collect() == []


def test_long_text_and_hot_pair(spark):
    """A text beyond a slice, and one pair in every document."""
    rows = [(i, "the end") for i in range(3000)] + [(9999, "the end of it " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in A.alignment(docs, outputs=(), block=2000).collect()}
    assert len(got) == 3001 and got[0] == got[0] and got[0]["count_sum"] >= 2 * 3000 and got[9999]["n_a"] >= 800_000


def test_fast_encoder_equals_the_files_own_library():
    byte_level = A.ByteLevel(open(A.A_FILE, encoding="utf-8").read())
    points = [c for c in range(0x3000)] + [c for c in range(0x3000, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}b {c} {c}{c}1{c}! {c}s'{c}  {c}\n{c}" for c in map(chr, points)]
    assert all(byte_level.encode(t) == byte_level.slow(t) for t in texts)
    assert json.loads(byte_level.text)["model"]["vocab"]["<|endoftext|>"] == byte_level.size if "<|endoftext|>" in json.loads(byte_level.text)["model"]["vocab"] else True
    blanks = " " * 1_500_000
    assert byte_level.encode(blanks) == byte_level.slow(blanks)


# ------------------------------------------------------------------ 13, decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def spell(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, span=10):
    windows = defaultdict(set)
    for i, text in items:
        w = spell(text)
        for s in range(max(len(w) - span, 0) + 1 if w else 0):
            windows[tuple(w[s : s + span])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = spell(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in held if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_equals_a_plain_version(spark):
    """Random words of a small stock, items of 1 to 25 words, so that windows overlap, repeat and tie."""
    r = random.Random(11)
    stock = ["a", "B", "c1", "Über", "über", "日本", "x-y", "it's", "end."]
    text = lambda n: " ".join(r.choice(stock) for _ in range(n))
    items = [(i % 25, text(r.choice([1, 2, 3, 4, 5, 9, 10, 11, 25]) + 3 * (i % 3))) for i in range(30)] + [(None, text(12)), (50, ""), (51, None), (52, "!!")]
    docs = [(i, text(r.randrange(60)) + " " + (r.choice(items)[1] or "") + " " + text(5)) for i in range(80)] + [(3, "a B"), (None, items[3][1]), (90, None), (91, ""), (92, " \n"), (90, items[2][1])]
    got = D.report(*frames(spark, docs, items))
    assert sorted(map(tuple, got.collect()), key=str) == plain_hits(docs, items)


def test_decontamination_of_the_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, D.query(spark, sf).collect()), key=str) == plain_hits(docs, items)


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"before {passage} after {i}") for i in range(50)] + [(60, "w1 " * 200_000 + passage), (61, "nothing of it")]
    items = [(i, f"{passage} {i}") for i in range(20)]
    assert sorted(map(tuple, D.report(*frames(spark, docs, items)).collect()), key=str) == plain_hits(docs, items)


def test_decontamination_spans_and_empty_tables(spark, clashing, none):
    docs, items = frames(spark, [(1, "x a b c y a b c a b z c y")], [(7, "a b c"), (8, "c y")])
    row = D.decontaminate(docs, items).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 8), (11, 13)] and row["items"] == ["7", "8"] and row["n_hit"] == 9
    _, no_items = frames(spark, [(1, "a")], [(1, "!")])
    assert D.report(clashing, no_items).where("contaminated").count() == 0 and D.report(clashing, no_items).count() == clashing.count()
    assert D.report(none, items).collect() == []


def test_no_python_in_decontamination(spark, sf):
    plan = D.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
