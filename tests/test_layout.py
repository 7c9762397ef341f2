"""Work of small tables is dealt to many tasks, with the same results."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity as Y
from tonearm.functions import text as X
from tonearm.operators import enrichment as N
from tonearm.operators import fraud as D
from tonearm.operators import loudness as LO
from tonearm.plans import reports as P
from tonearm.queries import checks as C
from tonearm.queries import files as QF
from tonearm.queries import operations as Q
from tonearm.queries import signals as G
from tonearm.sources import stores as K
from tonearm.streaming import outbox as O


def _tasks(df):
    """Rows of each task that has any."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_deliveries_of_one_organisation_are_cut(spark, monkeypatch):
    monkeypatch.setattr(K, "MEETING", 500, raising=False)
    events = spark.range(200).coalesce(1).select(F.lit(1).alias("org_id"), F.lit("scan").alias("event"), F.col("id").alias("payload"))
    ends = spark.range(30).coalesce(1).select(F.lit(1).alias("org_id"), F.concat(F.lit("u"), "id").alias("url"), F.array(F.lit("scan"), F.lit("scan")).alias("events"), (F.col("id") % 3 > 0).alias("active"))
    found = K.deliveries(events, ends)
    assert found.count() == found.distinct().count() == 200 * 20
    assert max(_tasks(found)) < 3000


def test_retries_compare_failures_only(spark, tmp_path):
    """Events that come twice go out once; the log of what arrived isn't shuffled for what is due, and an empty log not at all."""
    events = spark.createDataFrame([(1, 1, "scan", "a"), (1, 1, "scan", "b"), (1, 2, "scan", "c"), (2, 1, "scan", "d"), (None, 1, "scan", "e"), (None, 1, "scan", "f")], "event_id int, org_id int, event string, payload string")
    ends = spark.createDataFrame([(1, "u", ["scan"], True), (1, "u", ["scan"], True), (1, "v", ["scan"], True), (2, "u", ["scan"], True), (2, "w", ["scan"], False)], "org_id int, url string, events array<string>, active boolean")
    out = O.outgoing(events, ends)
    got = sorted((r["url"], r["payload"] if r["payload"] == "d" else "?") for r in out.collect())
    assert got == [("u", "?"), ("u", "?"), ("u", "d"), ("v", "?"), ("v", "?"), ("v", "d")] and out.select("delivery_id").distinct().count() == 6
    path, at = str(tmp_path / "log"), lambda m: F.timestamp_seconds(F.lit(60 * m))
    assert "Join" not in O.read_log(spark, path).join(out, "delivery_id")._jdf.queryExecution().optimizedPlan().toString()
    O.deliver(out, path, 0, lambda r: 503 if r["url"] == "u" else 200, at(0))
    waiting = O.due(O.read_log(spark, path), at(1))
    assert sorted(r["attempt"] for r in waiting.collect()) == [2, 2, 2] and "Aggregate [delivery_id" in waiting._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in waiting._jdf.queryExecution().optimizedPlan().toString()


def test_meeting_of_many_is_cut_by_both(spark, monkeypatch):
    """Copies of events and endpoints stay near the tables' size, and neither is sent to all tasks."""
    monkeypatch.setattr(K, "MEETING", 400)
    events = spark.range(300).select(F.lit(1).alias("org_id"), F.lit("scan").alias("event"), F.col("id").alias("payload"))
    ends = spark.range(200).select(F.lit(1).alias("org_id"), F.concat(F.lit("u"), "id").alias("url"), F.array(F.lit("scan")).alias("events"), F.lit(True).alias("active"))
    found = K.deliveries(events, ends)
    assert found.count() == found.distinct().count() == 300 * 200
    plan = found._jdf.queryExecution()
    assert "BroadcastHashJoin" not in plan.sparkPlan().toString().split("SortMergeJoin")[0] and "SortMergeJoin" in plan.sparkPlan().toString()
    assert "__end" in plan.optimizedPlan().toString()  # by events alone 150 copies of each endpoint were made, now 15
    monkeypatch.setattr(K, "TASKS", 10)
    assert K.deliveries(events, ends).rdd.getNumPartitions() == 10 and K.deliveries(events, ends).count() == 300 * 200


def test_log_without_ids_and_partial_batches(spark, tmp_path):
    """What the log has in part is sent in part, first or later, and neither ids nor shuffles of whole batches are needed for it."""
    events = spark.createDataFrame([(i, 1, "scan", f"p{i}") for i in (1, 2, 3)], "event_id int, org_id int, event string, payload string")
    ends = lambda *urls: spark.createDataFrame([(1, u, ["scan"], True) for u in urls], "org_id int, url string, events array<string>, active boolean")
    path, at = str(tmp_path / "log"), lambda m: F.timestamp_seconds(F.lit(60 * m))
    send = lambda r: 503 if r["url"] != "v" else 200
    keys = lambda df: sorted((r["event_id"], r["url"], r["attempt"]) for r in df.collect())
    O.deliver(O.outgoing(events.where("event_id < 3"), ends("u", "v")), path, 0, send, at(0))
    again = O.unsent(O.outgoing(events.where("event_id < 3"), ends("v", "u")), O.read_log(spark, path))
    assert again.isEmpty() and "Join" not in again._jdf.queryExecution().optimizedPlan().toString()
    O.deliver(O.outgoing(events, ends("u", "v", "w")), path, 0, send, at(0))
    log = O.read_log(spark, path)
    assert keys(log) == [(str(i), u, 1) for i in (1, 2, 3) for u in "uvw"]
    assert "delivery_id" not in spark.read.parquet(path).columns
    log.drop("event_id").write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="without event_id"):
        O.read_log(spark, str(tmp_path / "old"))
    assert {r["delivery_id"] for r in log.collect()} == {hashlib.sha256(f"{i}\n{u}".encode()).hexdigest() for i in (1, 2, 3) for u in "uvw"}
    O.deliver(O.due(log, at(1)).where("event_id = '1' or event_id = '2' and url = 'u'"), path, 1, send, at(1))
    assert keys(O.due(O.read_log(spark, path), at(1))) == [("2", "w", 2), ("3", "u", 2), ("3", "w", 2)]
    assert keys(O.unsent(O.due(log, at(1)), O.read_log(spark, path))) == [("2", "w", 2), ("3", "u", 2), ("3", "w", 2)]
    assert keys(O.due(O.read_log(spark, path), at(3))) == [("1", "u", 3), ("1", "w", 3), ("2", "u", 3), ("2", "w", 2), ("3", "u", 2), ("3", "w", 2)]


def test_track_loudness_shuffles_no_samples(spark, tmp_path):
    spark.range(300, 312).coalesce(1).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    found = Q.track_loudness(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "samples" in plan and not any("samples" in line for line in plan.splitlines() if "Repartition" in line)
    rate, n, k, b = 8000, 4000, F.col("s_suppkey"), F.col("block")
    s = spark.range(300, 312).select(F.col("id").alias("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("block")).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    height, strength = 100 + (k * 37) % 2000 + F.col("channel") * 50, F.pow(F.lit(10.0), -((k + b * (k % 3)) % 40) / 20)
    sample = lambda i: strength * F.sin(2 * math.pi * height * (b * n + i) / rate)
    plain = LO.loudness(s.select(k.alias("track"), "channel", "block", F.lit(rate).alias("rate"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample).alias("samples")))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for got, want in zip(rows(found), rows(plain), strict=True):
        assert got[0] == want[0] and all(abs(x - y) < 2e-6 for x, y in zip(got[1:], want[1:], strict=True))
    back = spark.createDataFrame([(1, 0, 2, 8000, [0.1] * 900), (1, 0, 1, 8000, [0.1] * 900)], "track int, channel int, block int, rate int, samples array<double>").coalesce(1)
    with pytest.raises(Exception, match="block 1 after 2"):
        LO.energies(back, in_order=True).collect()


def test_neighbours_are_not_broadcast(spark):
    """Some hundred neighbours a name are no small table, though the planner counts names."""
    left = spark.range(50).select(F.concat(F.lit("supplier "), "id").alias("n"))
    names = spark.range(20).select(F.concat(F.lit("supplier "), (F.col("id") * 37).cast("string")).alias("k"), F.col("id").alias("p"))
    found = Y.first_near(left, names, "n", "k", "p")
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [__n#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert found.count() == 50 and found.where("n = 'supplier 37'").first()["distance"] > 0  # supplier 0 comes first


def test_tenths_are_not_broadcast(spark, tmp_path):
    """A track has 600 tenths a minute, though the planner sizes them like the tracks."""
    spark.range(3).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    found = Q.track_loudness(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["s_suppkey"], r["seconds"]) for r in found.collect()) == [(0, 6.0), (1, 6.0), (2, 6.0)]


def test_isrc_lookup_beyond_five_digits(spark, tmp_path):
    keys = [0, 4, 9_999, 10_000, 10_001, 100_000, 100_001, 100_002, 100_003, 1_000_001, 1_000_002]
    spark.createDataFrame([(k, f"title {k}") for k in keys], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    status = lambda k: "invalid" if k % 3 == 2 else "not_found" if k % 2 else "ok" if k % 4 == 0 else "mismatch"
    isrc = lambda k: f"bad-{k}" if k % 3 == 2 else "gb-abc-26-" + str(k).rjust(5, "0")[:5]
    assert sorted(tuple(r) for r in G.isrc_lookup(spark, str(tmp_path)).collect()) == [(k, isrc(k), status(k)) for k in keys]
    twice = spark.createDataFrame([("USPR12600001", "b"), ("us-pr1-26-00001", "a")], "isrc string, r_title string")
    for held in (twice, twice.orderBy("r_title").coalesce(1)):
        assert N.isrc_lookup(spark.createDataFrame([(1, "USPR12600001", "a")], "id int, isrc string, title string"), held, "id").first()["status"] == "ok"


def test_near_names_make_no_shuffle_of_pairs(spark):
    left = spark.createDataFrame([("abcd",), ("abce",), ("ab",), ("",), ("zzzzz",)], "n string")
    names = spark.createDataFrame([("abcde", 2), ("abcd", 3), ("abdc", 3), ("b", 1), ("abxy", 9)], "k string, p int")
    found = Y.first_near(left, names, "n", "k", "p")
    assert sorted(tuple(r) for r in found.collect()) == [("", "b", 1, 1), ("ab", "b", 1, 1), ("abcd", "abcde", 2, 1), ("abce", "abcde", 2, 1)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [n#" in line]
    assert joins and all("k#" not in line.split("],")[0] for line in joins)  # pairs are never made distinct
    assert Y.first_near(left, names.where("p = 3"), "n", "k", "p").where("n = 'abce'").first()["k"] == "abcd"


def test_rules_of_one_small_file_are_many_tasks(spark, tmp_path):
    """60,000 parts in one file, which is one task as it is read."""
    spark.range(60_000).coalesce(1).select(F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("c").alias("p_type"), F.lit(7).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    assert C.rule_eval(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_tracks_of_an_organisation_meet_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "TRACKS", 100, raising=False)
    tracks = spark.range(1000).select((F.col("id") % 300).alias("release_id"), F.concat(F.lit("us-pr1-26-0000"), (F.col("id") % 7).cast("string")).alias("isrc"))
    found = P.org_isrcs(tracks, spark.range(300).select(F.col("id").alias("release_id"), (F.col("id") % 2).alias("org_id")))
    want = tracks.toPandas().assign(org_id=lambda x: x["release_id"] % 2, isrc=lambda x: x["isrc"].str.upper().str.replace("-", "")).groupby(["org_id", "isrc"])["release_id"].agg(["min", "nunique"])
    assert {(r["org_id"], r["isrc"]): (r["release_id"], r["releases"]) for r in found.collect()} == {k: tuple(v) for k, v in want.iterrows()}
    assert "RepartitionByExpression [release_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_made_once(spark):
    words = spark.createDataFrame([("Deep SLEEP lab",), ("Rain sounds",), ("Anna",), (None,), ("",)], "t string")
    got = [tuple(r) for r in words.select(X.has_word(F.col("t"), X.FUNCTIONAL_WORDS), F.size(X.words_found(F.col("t"), X.FUNCTIONAL_WORDS)) > 0).collect()]
    assert [bool(a) for a, _ in got] == [b for _, b in got] == [True, True, False, False, False]
    rows = spark.createDataFrame([(1, "Deep Sleep", "Calm", None, None, [("Rain 1", 9), ("rain 2", 9), ("Rain 3", 9)])], "release_id int, artist string, title string, publisher string, iswc string, tracks array<struct<title:string,duration_ms:long>>")
    rows = rows.withColumn("tracks", F.transform("tracks", lambda t: t.withField("composer", F.lit(None).cast("string"))))
    plan = D.lone_signals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]+\\s*$") <= 2
    assert {r["signal_id"] for r in D.lone_signals(rows).collect()} >= {"fraud.functional_music_spam", "fraud.short_track_duration", "fraud.ai_generation_suspected"}


def test_candidates_are_dealt_by_key(spark, tmp_path):
    spark.range(40_000).coalesce(1).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("c").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    plan = G.best_candidates(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan


def test_json_texts_of_one_small_file_are_many_tasks(spark, tmp_path):
    """60,000 releases in one file, which is one task as it is read."""
    spark.range(60_000).coalesce(1).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    assert QF.json_findings(spark, str(tmp_path)).rdd.getNumPartitions() == 3
