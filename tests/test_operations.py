"""Rule versions, snapshots, the outbox, candidate search, messages and table functions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity as Y
from tonearm.operators import search as S
from tonearm.plans import rules as R
from tonearm.plans import ruleversions as V
from tonearm.plans.snapshots import Snapshots
from tonearm.sources import bulk as SB
from tonearm.sources import messages as G
from tonearm.streaming import outbox as O


def test_rules_added_between_batches_judge_the_later_ones_only(spark, tmp_path):
    table = V.RuleTable(spark, str(tmp_path / "rules"))
    assert table.version() == 0 and table.snapshot() == []
    table.change([R.Rule("a", "metadata.title == 'x'"), R.Rule("b", "metadata.artwork_width > 1", active=False)])
    fields = {"title": "text", "artwork_width": "number"}
    reloading = V.Reloading(table, ["id"], record_fields=fields)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "x", 5)], "id int, title string, artwork_width int")
    rows.coalesce(1).write.parquet(str(folder / "0"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    run = lambda: V.judge_stream(stream, reloading, sink, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    assert table.change([R.Rule("b", "metadata.artwork_width > 1"), R.Rule("c", "metadata.artwork_width > 9")], ["a"]) == 2
    spark.createDataFrame([(2, "x", 5)], rows.schema).coalesce(1).write.parquet(str(folder / "1"))
    run()
    got = {(r["id"], r["rule_id"], r["status"], r["rules_version"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a", "pass", 1), (2, "b", "pass", 2), (2, "c", "fail", 2)}
    assert reloading.loads == 2 and [r.id for r in table.snapshot(1)] == ["a", "b"] and [r.id for r in table.snapshot()] == ["b", "c"]
    reloading.judge(rows)
    assert reloading.loads == 2  # nothing changed, nothing compiled


def test_snapshots_end(spark, tmp_path):
    now, made = [1000.0], []
    store = Snapshots(spark, str(tmp_path / "s"), lambda: now[0])

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    read = lambda **k: store.read("overview", {"org": 1}, make, **k).first()["n"]
    assert (read(), read(), len(made)) == (1, 1, 1)
    now[0] += 3599
    assert read() == 1 and store.read("overview", {"org": 2}, make).first()["n"] == 2
    now[0] += 2
    assert read() == 3 and read() == 3
    now[0] += 1
    assert read(refresh=True) == 4 and read() == 4
    now[0] += 7200
    assert store.purge(store.key("overview", {"org": 1})) == 3
    token = store.share(spark.createDataFrame([(7,)], "n int"))
    now[0] += 7 * 24 * 3600 - 1
    assert store.shared(token).first()["n"] == 7
    now[0] += 2
    assert store.shared(token) is None and store.shared("../x") is None
    (tmp_path / "s" / store.key("half", {}) / "made=1-until=99999999999999-x").mkdir(parents=True)  # never committed
    assert store.get(store.key("half", {})) is None


def test_outbox_sends_once_and_tries_again(spark, tmp_path):
    events = spark.createDataFrame([(1, "o", "scan", "p1"), (2, "o", "scan", "p2"), (3, "o", "other", "p3"), (4, "x", "scan", "p4")], "event_id int, org_id string, event string, payload string")
    ends = spark.createDataFrame([("o", "u1", ["scan", "scan"], True), ("o", "u2", ["scan"], True), ("o", "u3", ["scan"], False)], "org_id string, url string, events array<string>, active boolean")
    sent = tmp_path / "sent"
    sent.mkdir()
    counter = str(sent)

    def send(r):
        import uuid

        open(f"{counter}/{r['payload']}-{r['url']}-{r['attempt']}-{uuid.uuid4().hex}", "w").close()
        if r["payload"] == "p2":
            raise OSError("down")
        return 204

    path, at = str(tmp_path / "log"), lambda m: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * m))
    for _ in range(2):  # the second is a replay
        O.deliver(O.outgoing(events, ends), path, 0, send, at(0))
    names = sorted("-".join(p.name.split("-")[:3]) for p in sent.iterdir())
    assert names == ["p1-u1-1", "p1-u2-1", "p2-u1-1", "p2-u2-1"]
    for minute in range(1, 40):
        waiting = O.due(O.read_log(spark, path), at(minute))
        if minute in (1, 3, 7, 15, 31):
            O.deliver(waiting, path, minute, send, at(minute))
        elif minute in (2, 8, 30):
            assert waiting.count() == 0
    log = O.read_log(spark, path)
    assert {(r["payload"], r["attempt"], r["status"]) for r in log.collect()} == {("p1", 1, "delivered"), *[("p2", a, "failed") for a in (1, 2, 3, 4)], ("p2", 5, "given_up")}
    assert log.count() == len(list(sent.iterdir())) == 12 and O.due(log, at(10_000)).count() == 0


def test_search_equals_all_pairs(spark):
    r = random.Random(4)
    stock = ["the", "the", "the", "love", "night", "blue", "ring", "sea", "stone", "köln", "x1"]
    text = lambda n: " ".join(r.choice(stock) for _ in range(n))
    held = [(i, text(r.randrange(1, 5)), text(r.randrange(0, 3))) for i in range(150)] + [(200, None, None), (None, "love", "x"), (201, "The-LOVE!", "sea")]
    asked = [(i, text(r.randrange(1, 5)), text(r.randrange(0, 3))) for i in range(60)] + [(90, "", None), (91, "unknown words", "zzz"), (91, "love", "sea")]
    import math
    import re

    words = lambda t, a: {f"t:{w}" for w in re.findall(r"\w+", (t or "").lower())} | {f"a:{w}" for w in re.findall(r"\w+", (a or "").lower())}
    sets = [(i, words(t, a)) for i, t, a in held if i is not None and words(t, a)]
    df = {}
    for _, s in sets:
        for w in s:
            df[w] = df.get(w, 0) + 1
    u = lambda w: round(math.log(1 + len(sets) / df.get(w, 1)) * 1_000_000)
    want = []
    for i, t, a in asked:
        q = words(t, a)
        scores = sorted(((-sum(map(u, q & s)) / sum(map(u, q | s)), j) for j, s in sets if q), key=lambda x: (x[0], x[1]))
        want += [(i, n, j, round(-o, 9)) for n, (o, j) in enumerate([x for x in scores if -x[0] >= S.LEAST][: S.MOST], 1)]
    rows = lambda x, name: spark.createDataFrame(x, f"{name} int, title string, artist string")
    found = S.search(rows(asked, "k"), rows(held, "recording_id"), "k")
    assert sorted((x["k"], x["pos"], x["recording_id"], round(x["overlap"], 9)) for x in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_lookup_by_isrc_then_by_search(spark):
    recordings = spark.createDataFrame([(3, "USPR12600001", "Blue Ring", "Ann"), (1, "us-pr1-26-00001", "Blue Ring", "Ann"), (7, "USPR12600002", "Night Sea", "Bob"), (9, None, "Stone Love Song", "Cid")], "recording_id int, isrc string, title string, artist string")
    releases = spark.createDataFrame(
        [("a", ["bad", "USPR12600002", "USPR12600001", "USPR12600002"], "x", "y"), ("b", ["USPR12699999"], "Stone Love", "Cid"), ("c", [], "Stone", "Nobody"), ("d", None, " ", "Cid"), ("e", [], "unheard", "of")],
        "k string, isrc_list array<string>, title string, artist string",
    )
    got = {r["k"]: (r["via"], r["recordings"], r["confidence"]) for r in S.lookup(releases, recordings, "k").collect()}
    assert got == {"a": ("isrc", [7, 1], None), "b": ("search", [9], "medium"), "c": (None, None, None), "d": (None, None, None), "e": (None, None, None)}


def test_similarity_of_mixed_names(spark):
    """The library's ratio, on names that are neither equal nor disjoint, and best_candidates by it."""
    import difflib

    names = ["Blue Ring", "blue ring (live)", "Bleu Rnig", "", None, "Ring, Blue", "x"]
    pairs = list(itertools.product(names, names))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", Y.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    plain = lambda a, b: difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() if a and b else 0.0
    assert all(abs(r["r"] - plain(r["a"], r["b"])) < 1e-12 for r in got)


def test_layout_lines(spark):
    ean = "0123456789012"
    texts = [("a", f"Catalogue\n{ean}   Ann   Blue  Ring  (live)   010224   Imp\n\n {ean}  Ann  no date\n{ean} 130124  x\n{ean}Ann  Title  123124  X\n"), ("b", f"{ean}|A|T|010224\nrest"), ("c", f"{ean},A,T,010224"), ("d", f"{ean} | A | T | 010224 | I | L | 00 tail"), ("e", ""), ("f", None)]
    got = {}
    for r in SB.rows_of_page_text(spark.createDataFrame(texts, "path string, text string")).orderBy("path", "row_number").collect():
        got.setdefault(r["path"], []).append((r["line"], r["delimiter"]))
    assert got == {
        "a": [("Catalogue", "|"), (f"{ean}|Ann|Blue Ring (live)|010224|Imp", "|"), (f"{ean}|Ann|no date", "|"), (f"{ean}|130124|x", "|"), (f"{ean}|Ann|Title|123124|X", "|")],
        "b": [(f"{ean}|A|T|010224", "|"), ("rest", "|")], "c": [(f"{ean},A,T,010224", ",")], "d": [(f"{ean} | A | T | 010224 | I | L | 00", "|")],
    }


def test_messages_by_one_walk():
    text = """<n:M xmlns:n="http://ddex.net/xml/ern/43"><n:ResourceList><n:SoundRecording><X><ISRC> </ISRC></X><ISRC>A</ISRC><n:TitleText>T1</n:TitleText><Contributor><R><Role>MusicPublisher</Role></R><PartyName><FullName>Pub</FullName></PartyName></Contributor></n:SoundRecording>
    <n:SoundRecording><DisplayArtist><PartyName><FullName>Ann</FullName></PartyName></DisplayArtist></n:SoundRecording><Image><ImageType>Back</ImageType><ImageWidth>1</ImageWidth></Image><Image><ImageType>FrontCoverImage</ImageType><D><ImageHeight>3000</ImageHeight><ImageWidth>x</ImageWidth></D></Image></n:ResourceList>
    <ReleaseList><Release><ReleaseType>Single</ReleaseType><TitleText>Other</TitleText></Release><Release IsMainRelease="true"><ICPN>1</ICPN><TitleText>Plain</TitleText><ReferenceTitle><Y><TitleText>Main</TitleText></Y></ReferenceTitle><ReleaseDetailsByTerritory><TerritoryCode>DE</TerritoryCode><LabelName>D</LabelName></ReleaseDetailsByTerritory>
    <ReleaseDetailsByTerritory><TerritoryCode>Worldwide</TerritoryCode><LabelName>W</LabelName></ReleaseDetailsByTerritory></Release></ReleaseList><UPC>9</UPC></n:M>"""
    m = G.parse_message(text)
    assert [(t["isrc"], t["title"], t["publisher"], t["artist"]) for t in m["tracks"]] == [("A", "T1", "Pub", None), (None, None, None, "Ann")]
    assert (m["ern_version"], m["profile"], m["artwork_height"], m["artwork_width"], m["upc"], m["title"], m["label"], m["upcs"]) == ("ERN43", "Single", 3000, None, "1", "Main", "W", ["9"])
    assert set(m["missing"]) == {"MessageHeader", "DealList", "MessageId", "MessageSender", "MessageRecipient", "MessageCreatedDateTime"}


def test_message_findings_parse_once(spark):
    files = spark.createDataFrame([("a", "<x/>")], "path string, text string")
    plan = G.xml_findings(files.select("path", G.parse_xml(F.col("text")).alias("m")), "u")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("parse(") == 1


def test_table_functions_in_sql(spark):
    G.register_table_functions(spark)
    spark.createDataFrame([("j", '[{"upc":"1","title":" x ","tracks":[{"isrc":"A"},3]},7]'), ("k", "{")], "path string, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT path, r.error IS NULL AS fine, r.pos, r.upc, r.title, r.n_tracks, r.isrcs FROM texts, LATERAL parse_json_releases(text) AS r").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("j", True, 0, "1", "x", 1, ["A"]), ("j", False, 1, None, None, None, None), ("k", False, None, None, None, None, None)], key=str)
    rows = spark.sql("SELECT t.* FROM (SELECT '﻿B , A\n1,\"x\ny\"\n\n2\n' AS text), LATERAL parse_csv(text, 'a', 'B', 'none') AS t").collect()
    assert [tuple(r) for r in rows] == [(2, "x\ny", "1", None), (3, None, "2", None)]
    with pytest.raises(Exception, match="name the columns"):
        spark.sql("SELECT * FROM texts, LATERAL parse_csv(text)").collect()


def test_search_shuffles_no_pairs(spark, monkeypatch):
    """3,000 sets of three words, each word of 150 to 180 sets: 1.4 million pairs meet, the shuffles hold postings and the best few; tiles of a word find the same."""
    rows = lambda name: spark.createDataFrame([(i, f"a{i % 20} b{i % 19} c{i % 17}", "") for i in range(3000)], f"{name} int, title string, artist string")
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    found = {tuple(r) for r in S.search(rows("k"), rows("recording_id"), "k").collect()}
    assert len(found) == 15_000 and shuffled() - before < 10_000_000
    assert {(k, r) for k, pos, r, _ in found if pos == 1} == {(i, i) for i in range(3000)}
    monkeypatch.setattr(S, "TILE", 64)
    assert {tuple(r) for r in S.search(rows("k"), rows("recording_id"), "k").collect()} == found


def test_search_cuts_words_by_postings(spark, monkeypatch):
    """A word of 2,002 sets that only two of them post is one tile: in the rest rarer words outweigh it, so its postings aren't copied for those."""
    rows = [(i, f"a{i % 400} b{i % 397} c{i % 389} night love") for i in range(2000)] + [(2000, "night"), (2001, "love"), (2002, "night love")]
    songs = spark.createDataFrame(rows, "k int, title string").withColumn("artist", F.lit(""))
    tiled, seen = S._tiled, []
    monkeypatch.setattr(S, "_tiled", lambda *a: seen.append(tiled(*a)) or seen[-1])
    monkeypatch.setattr(S, "TILE", 64)
    found = {tuple(r) for r in S.search(songs, songs.withColumnRenamed("k", "recording_id"), "k").collect()}
    for side in seen:
        assert side.count() == side.select("sid", "w").distinct().count()
    monkeypatch.setattr(S, "TILE", 8192)
    assert {tuple(r) for r in S.search(songs, songs.withColumnRenamed("k", "recording_id"), "k").collect()} == found and len(found) > 2000


def test_lookup_shuffles_no_pairs(spark):
    """2,000 releases without a known ISRC are searched among recordings whose words each stand in 100 to 118."""
    rows = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.expr("concat('song', id % 20, ' night', id % 19, ' ring', id % 17)").alias("title"), F.lit("Ann").alias("artist"))
    recordings = rows.select(F.col("k").alias("recording_id"), F.lit(None).cast("string").alias("isrc"), "title", "artist")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    found = S.lookup(rows.select("k", F.array(F.lit("bad")).alias("isrc_list"), "title", "artist"), recordings, "k").collect()
    assert {(r["k"], r["via"], tuple(r["recordings"]), r["confidence"]) for r in found} == {(i, "search", (i,), "high") for i in range(2000)}
    assert store.executorSummary("driver").totalShuffleWrite() - before < 10_000_000
