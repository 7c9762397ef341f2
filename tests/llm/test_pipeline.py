import corpus_pipeline
from tonearm.llm import registry


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names, name
        if name in ("language_id", "secret_scan", "sentencepiece"):
            assert docs.count() == before  # these tables hold no text without a language
        if name == "minhash_near_dedup":
            assert 0 < docs.count() < before
    assert docs.where("not round_trip").count() == 0


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_run_equals_a_plain_version_of_all_stages(spark, sf):
    import hashlib
    import math

    import numpy as np
    from test_text_operators import brute_components

    from tonearm.llm import common as C
    from tonearm.llm import langid, mixing, secrets, sentencepieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    # language: plain sums of the learned log-probabilities
    langs, matrix = langid.fit(docs)
    bits, kept = matrix.shape[0].bit_length() - 1, {}
    for i, r in rows.items():
        raw = np.frombuffer(" ".join((r["text"] or "").split(" ")).encode(), np.uint8)
        folded, _ = langid._pieces(raw, np.array([0, len(raw)]))
        grams = [k for _, b in langid._grams(folded, bits) for k in b.tolist()] if len(folded) else []
        if not grams or not any(c.isalpha() for c in r["text"] or ""):
            continue
        s = sum(matrix[k].astype(float) for k in grams) * min(len(grams), langid.EVIDENCE) / len(grams)
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        if p.max() >= langid.LEAST_SCORE:
            kept[i] = r
    # near copies: full sets of five words
    classes = brute_components([(i, r["text"]) for i, r in kept.items()], 5, 80)
    kept = {i: r for i, r in kept.items() if classes[i][1] == i}
    # secrets: the findings' places, cut out of the text
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(docs, model, keep=["doc_id"]).where("is_secret").collect()
    for i in kept:
        text = kept[i]["text"]
        for f in sorted((f for f in found if f["doc_id"] == i), key=lambda f: -f["start"]):
            text = text[: f["start"]] + secrets.MARK + text[f["start"] + f["length"] :]
        kept[i]["text"] = text
    # mixing: the inverse Poisson at a hashed number
    count = {}
    for r in kept.values():
        count[r["source"]] = count.get(r["source"], 0) + 1
    total = sum(n**mixing.ALPHA for n in count.values())
    copies = {}
    for i, r in kept.items():
        rate = count[r["source"]] ** mixing.ALPHA / total * len(kept) / count[r["source"]]
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        p = cdf = math.exp(-rate)
        n = 0
        while u > cdf:
            n += 1
            p *= rate / n
            cdf += p
        copies[i] = n
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["round_trip"]))
    assert {i: len(v) for i, v in got.items()} == {i: n for i, n in copies.items() if n}
    want = spark.createDataFrame([(i, kept[i]["text"]) for i in got], "doc_id long, text string")
    tokens = {r["doc_id"]: r["n_tokens"] for r in sentencepieces.encode(want).collect()}
    assert all(n == tokens[i] and same for i, v in got.items() for n, same in v)
