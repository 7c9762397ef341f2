import datetime as dt

from pyspark.sql import functions as F

from tonearm.operators import media as M
from tonearm.plans import analytics as A
from tonearm.plans import reports as P
from tonearm.plans import rules as R
from tonearm.plans import scan as SC
from tonearm.sources import stores as K
from tonearm.streaming import events as E

from test_streaming import at, drain, stream


def test_shares_round_halves_up(spark):
    one = lambda a, b: spark.range(1).select(P.whole_percent(F.lit(a), F.lit(b))).first()[0]
    assert [one(1, 8), one(1, 200), one(5, 8), one(0, 3), one(0, 0)] == [13, 1, 63, 0, None]


def test_no_severity_is_dropped(spark):
    r = spark.createDataFrame([(1, s, i) for i, s in enumerate(["info", "error", "warning", "odd", "critical", "error"])], "scan_id int, severity string, line int")
    assert [x["severity"] for x in P.issue_groups(r, ["scan_id"], ["line"]).orderBy("place").collect()] == ["critical", "error", "error", "warning", "info", "odd"]


def test_groups_without_findings_have_zeros(spark):
    r = spark.createDataFrame([(1, "isrc_registration", "ISRC_FORMAT", "error", False), (1, "isrc_registration", "other", "critical", False), (1, "isrc_registration", "ISRC_DUPLICATE", "critical", True)], "scan_id int, layer string, rule_id string, severity string, resolved boolean")
    got = {x["rule_group"]: (x["critical_count"], x["warning_count"]) for x in P.group_counts(r, ["scan_id"], "isrc_registration").collect()}
    assert got == {"ISRC Validation": (1, 0), "Release Data": (0, 0)}


def test_newest_and_rule_lists(spark):
    rows = spark.createDataFrame([(1, at(1)), (2, None), (3, at(5)), (4, at(5))], "id int, made timestamp")
    assert [r["id"] for r in P.newest(rows, "made", "id", 4).collect()] == [4, 3, 1, 2]
    frame = R.rule_frame(spark, [R.Rule("a", "x", platform="apple"), R.Rule("b", "x"), R.Rule("c", "x", layer="fraud"), R.Rule("d", "x", active=False), R.Rule("b", "y")])
    ids = lambda **k: sorted(r["id"] for r in R.list_rules(frame, **k).collect())
    assert (ids(), ids(platform="spotify"), ids(layer="fraud"), ids(active_only=False)) == (["a", "b", "c"], ["b", "c"], ["c"], ["a", "b", "c", "d"])
    assert frame.count() == 4 and frame.where("id = 'b'").first()["check"] == "y"


def test_declared_sizes_and_short_tracks(spark):
    rows = [(1, 2999, 4000, [("a", 59_999), ("b", 60_000), (None, 1), ("c", None)]), (2, 0, 100, None), (3, 3000, 3000, [])]
    r = spark.createDataFrame(rows, "id int, artwork_width int, artwork_height int, tracks array<struct<title:string,duration_ms:long>>")
    got = sorted((x["id"], x["rule_id"], x["actual"]) for x in M.declared_findings(r, ["id"]).collect())
    assert got == [(1, "declared.artwork.resolution", "2999x4000"), (1, "declared.track.short", "0s"), (1, "declared.track.short", "59s")]


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, n long, week string"
    merge = lambda rows, how: K.merge_partitions(spark, path, spark.createDataFrame(rows, schema), how, "week")
    add = lambda a, b: K.add_counters(a, b, ["k", "week"])
    merge([("a", 1, "w1"), ("b", 2, "w1"), ("a", 5, "w2")], add)
    files = {p.name for p in (tmp_path / "t" / "week=w2").glob("*.parquet")}
    merge([("a", 10, "w1"), ("c", 1, "w3")], add)
    merge([], add)
    merge([("b", 99, "w1")], lambda a, b: K.upsert(a, b, ["k", "week"]))
    assert sorted(map(tuple, spark.read.schema(schema).parquet(path).collect())) == [("a", 5, "w2"), ("a", 11, "w1"), ("b", 99, "w1"), ("c", 1, "w3")]
    assert {p.name for p in (tmp_path / "t" / "week=w2").glob("*.parquet")} == files and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_weekly_counters_as_a_stream(spark, tmp_path):
    day = 24 * 60
    s, b = stream(spark, tmp_path, [[("a", at(0)), ("a", at(day))], [("a", at(8 * day)), ("b", at(2 * day))], [("a", at(40 * day))], [("z", at(80 * day))]], "endpoint string, created_at timestamp")
    got = drain(E.weekly_counters(s, ("endpoint",)), tmp_path, "append", "weekly")
    want = [tuple(r) for r in E.weekly_counters(b.where("endpoint <> 'z'"), ("endpoint",)).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and (dt.date(2024, 1, 1), "a", 2) in want


def test_batch_progress_and_usage_as_streams(spark, tmp_path):
    s, b = stream(spark, tmp_path, [[(1, "queued"), (2, "complete")], [(1, "complete"), (2, "failed")]], "job_id int, status string")
    last = {}
    for r in drain(A.batch_progress(s), tmp_path, "update", "progress").collect():
        last[r["job_id"]] = max(last.get(r["job_id"], ()), (r["total"], r["completed"], r["failed"], r["job_status"]))
    assert last == {r["job_id"]: (r["total"], r["completed"], r["failed"], r["job_status"]) for r in A.batch_progress(b).collect()}
    q = E.append_usage(s.withColumn("created_at", F.lit(at(0))), str(tmp_path / "usage"), str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.read.parquet(str(tmp_path / "usage")).where("day = date'2024-01-01'").count() == 4


def test_scan_of_layers(spark):
    releases = spark.createDataFrame([(1, "a", " P 1999 x", [("USPR12600001", "Ann"), ("", "Ann ")]), (2, "b", None, None), (3, "c", None, [])], "id int, title string, p_line string, tracks array<struct<isrc:string,composer:string>>")
    c = {r["id"]: r for r in SC.context(releases).collect()}
    assert (c[1]["isrc_list"], c[1]["composers"], c[1]["p_line_year"], c[2]["isrc_list"], c[2]["territory"]) == (["USPR12600001"], ["Ann"], "1999", [], "Worldwide")
    rules = [R.Rule("m.title", "metadata.title == 'a'", "critical", "title"), R.Rule("m.isrc", "metadata.title == 'zz'", "warning", "must match ISO 3901")]
    ddex = spark.createDataFrame([(1, "ddex.isrc", "error", "ISRC is odd")], "id int, rule_id string, severity string, message string")
    signals = spark.createDataFrame([(2, "fraud.high_release_velocity_org", "low", "fast"), (3, "short", "low", "short")], "id int, signal_id string, confidence string, explanation string")
    none = spark.createDataFrame([], "signal_id string, severity string, resolution string, advisory boolean")
    layers = {"metadata": SC.metadata_layer(SC.context(releases), "id", rules), "ddex": ddex, "fraud": SC.fraud_layer(signals, "id", none, releases.where("id = 2"))}
    found = SC.results(layers, "id")
    assert {(r["id"], r["layer"], r["rule_id"], r["duplicate"]) for r in found.collect()} == {(1, "ddex", "ddex.isrc", False), (1, "metadata", "m.isrc", True), (2, "metadata", "m.title", False), (2, "metadata", "m.isrc", False), (3, "metadata", "m.title", False), (3, "metadata", "m.isrc", False), (3, "fraud", "fraud.short", False)}
    assert {r["id"]: (r["critical_count"], r["warning_count"], r["info_count"], r["grade"]) for r in SC.scores(releases, found, "id").collect()} == {1: (0, 0, 1, "PASS"), 2: (1, 1, 0, "PASS"), 3: (1, 2, 0, "PASS")}
    only = SC.results(layers, "id", asked=("ddex", "fraud"), allowed=("ddex", "metadata"))
    assert {r["layer"] for r in only.collect()} == {"ddex"} and SC.scores(releases, only, "id").count() == 3
