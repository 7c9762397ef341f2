import datetime

import pytest
from pyspark.sql import functions as F

from tonearm.functions import identifiers as I
from tonearm.functions import similarity as Y
from tonearm.functions import text as X
from tonearm.operators import bulk as B
from tonearm.operators import enrichment as N
from tonearm.operators import findings as O
from tonearm.operators import fraud as D
from tonearm.operators import media as M
from tonearm.operators import scoring as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("ean,problem", [("0199584421445", None), ("4006381333931", None), ("4006381333932", "check digit"), ("0199584421445X", "not digits"), ("0" * 13, "all zeros"), ("123", "not 13 digits"), (None, "not digits")])
def test_ean(spark, ean, problem):
    got = one(spark, I.ean_problem(F.lit(ean).cast("string")))
    if ean == "0199584421445":
        digit = (10 - sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(ean[:12])) % 10) % 10
        problem = None if digit == int(ean[12]) else "check digit"
    assert got == problem


@pytest.mark.parametrize("raw,day", [("010199", datetime.date(2099, 1, 1)), ("023026", None), ("13012", None), ("130126", None), (" 022924 ", datetime.date(2024, 2, 29)), (None, None)])
def test_mmddyy(spark, raw, day):
    assert one(spark, I.mmddyy(F.lit(raw).cast("string"))) == day


def test_durations(spark):
    assert one(spark, I.iso_duration_ms(F.lit("PT3M45S"))) == 225_000 and one(spark, I.iso_duration_ms(F.lit("P1DT1H0.5S"))) == 90_000_500 and one(spark, I.iso_duration_ms(F.lit("3:45"))) is None
    assert one(spark, I.mmss_ms(F.lit("3:45"))) == 225_000 and one(spark, I.mmss_ms(F.lit("3:4"))) is None


def test_names(spark):
    norm = lambda s: one(spark, X.normalize_artist(F.lit(s).cast("string")))
    assert norm("RZA & Juice Crew") == norm("RZA,  Juice Crew") == "rza and juice crew"
    assert norm("Drake feat. Travis Scott") == "drake" and norm(None) == "" and norm("Beyoncé") == "beyoncé"
    assert one(spark, X.fold_lookalikes(F.lit("Аdеlе Ъ"))) == "Adele " and one(spark, X.fold_lookalikes(F.lit("Ａb"))) == "Ab"
    assert one(spark, X.strip_marks(F.lit("Beyoncé"))) == "Beyonce" and one(spark, X.nfc(F.lit("é"))) == "é"
    assert one(spark, X.rule_label(F.lit("universal.metadata.upc_required"))) == "Upc Required"
    assert one(spark, X.formulaic_titles(F.array(*[F.lit(x) for x in ("Sleep 1", "sleep 2", "Rain 3", "x")]))) == 2
    assert one(spark, X.generic_title(F.lit("Track 12"))) and not one(spark, X.generic_title(F.lit("Tracks of my tears")))


def test_similar_names(spark):
    left = spark.createDataFrame([(1, "drake"), (2, "dreke"), (3, "drke"), (4, "someone else"), (5, "dra")], "id int, artist string")
    known = spark.createDataFrame([("drake", 1), ("dreke b", 2), ("sade", 3)], "name string, pos int")
    got = {(r["id"], r["name"], r["distance"]) for r in Y.similar_names(left, known, "id", "artist", "name", "pos").collect()}
    assert got == {(2, "drake", 1), (3, "drake", 1), (5, "drake", 2)}


def scored(spark, c, w, i=0, **kw):
    rows = [(1, s) for s, n in (("critical", c), ("warning", w), ("info", i), ("pass", 1)) for _ in range(n)]
    return S.readiness(spark.createDataFrame(rows, "scan int, severity string"), ["scan"], **kw).first()


@pytest.mark.parametrize("c,w,score,grade", [(0, 0, 100, "PASS"), (1, 0, 90, "PASS"), (7, 0, 40, "FAIL"), (0, 1, 97, "PASS"), (2, 0, 80, "PASS"), (2, 1, 77, "WARN"), (4, 5, 45, "FAIL"), (2, 8, 56, "FAIL")])
def test_bulk_score(spark, c, w, score, grade):
    r = scored(spark, c, w, with_info=False)
    assert (r["score"], r["grade"]) == (score, grade)


def test_score_counts(spark):
    assert scored(spark, 0, 0, 3)["score"] == 98.5 and scored(spark, 0, 0, 40)["score"] == 95.0
    f = spark.createDataFrame([(1, "error", False, "ddex"), (1, "critical", True, "ddex"), (1, "critical", False, "enrichment")], "scan int, severity string, resolved boolean, layer string")
    assert S.readiness(f, ["scan"]).first()["score"] == 99.5 and S.readiness(f, ["scan"], error_as="critical").first()["score"] == 90.0


BULK = "row_number int, ean string, artist string, title string, release_date_raw string, imprint string, label string, narm_config string, label_abbreviation string, country_code string, isni string, iswc string"


def test_bulk_rows_and_groups(spark):
    rows = [
        (1, "4006381333931", "A", "T", "010124", "I", None, "02", "AB", "us", "0000000121032683", "T-123456789-0"),
        (2, "4006381333931", "a ", "t", "010124", None, None, "99", "ABCDEFGHIJK", "ZZ", "123X", "T-123.456.789-0"),
        (3, "x", " ", "T" * 256, "130124", "I", None, "", None, None, None, None),
        (4, "0" * 13, "B", "U", "010110", "I", None, "", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, BULK)
    got = {(r["row_number"], r["rule_id"], r["severity"]) for r in B.check_releases(df, ["US", "DE"], F.lit("2024-01-15").cast("date")).collect()}
    assert {x for x in got if x[0] == 1} == set()
    assert {x[1] for x in got if x[0] == 2} == {"BULK_IMPRINT_MISSING", "BULK_NARM_UNKNOWN", "BULK_LABEL_ABBR_INVALID", "BULK_COUNTRY_CODE_INVALID", "BULK_ISNI_FORMAT", "BULK_ISWC_FORMAT"}
    assert {x[1] for x in got if x[0] == 3} == {"BULK_EAN_FORMAT", "BULK_ARTIST_MISSING", "BULK_TITLE_MISSING", "BULK_DATE_FORMAT", "BULK_COUNTRY_CODE_MISSING", "BULK_ISNI_MISSING", "BULK_ISWC_MISSING"}
    assert (4, "BULK_DATE_FORMAT", "warning") in got and (4, "BULK_EAN_FORMAT", "critical") in got
    groups = {(r["rule_id"], tuple(sorted(m["row_number"] for m in B.group_rows(df).where(f"kind = '{r['kind']}' and key = '{r['key']}'").collect()))) for r in B.check_groups(df).collect()}
    assert groups == {("BULK_EAN_DUPLICATE", (1, 2)), ("BULK_TITLE_INCONSISTENT", (1, 2)), ("BULK_ISNI_CONFLICTING", (1, 2))}


def test_isrc_file(spark):
    df = spark.createDataFrame([(1, "US-PR1-26-00001", "A", "T", "999999", None, None, "US"), (2, "uspr12600001", "A", "T", "x", "ABCDEFGHIJK", None, None), (3, "bad", None, "", "010124", None, None, "1")], "row_number int, isrc string, artist string, title string, release_date_raw string, label_abbreviation string, label_name string, country_code string")
    got = {(r["row_number"], r["rule_id"]) for r in B.check_isrcs(df, ["US"]).collect()}
    assert got == {(2, "ISRC_DATE_FORMAT"), (2, "ISRC_LABEL_ABBR_INVALID"), (2, "ISRC_COUNTRY_CODE_MISSING"), (3, "ISRC_FORMAT"), (3, "ISRC_ARTIST_MISSING"), (3, "ISRC_TITLE_MISSING"), (3, "ISRC_COUNTRY_CODE_INVALID")}
    assert sorted((r["n"], r["row_number"]) for r in B.duplicate_isrcs(df).collect()) == [(2, 1), (2, 2)]


def test_catalogue_conflicts(spark):
    now = spark.createDataFrame([("o", "1", "Anna", "Songs", "11"), ("o", "2", "Ben & Co", "X", None)], "org_id string, ean string, artist string, title string, isni string")
    past = spark.createDataFrame(
        [("o", "1", "Anna", "Other", "11", 1, "s1", False), ("o", "1", "Eve", "Songs", "22", 2, "s2", False), ("o", "1", "Kim", "Songs", None, 3, "s3", False), ("o", "2", "ben and co", "x", "33", 1, "s4", False), ("p", "1", "Zoe", "Z", "44", 0, "s5", False), ("o", "1", "Demo", "D", "55", 0, None, True)],
        "org_id string, ean string, artist string, title string, isni string, first_seen int, scan_id string, is_demo boolean",
    )
    got = {(r["ean"], r["rule_id"], r["scan_id"]) for r in B.catalogue_conflicts(now, past).collect()}
    assert got == {("1", "CROSS_CATALOG_EAN_CONFLICT", "s2"), ("1", "CROSS_CATALOG_TITLE_CONFLICT", "s1"), ("1", "CROSS_CATALOG_ISNI_CONFLICT", "s2")}


def test_artist_mismatch(spark):
    isrc = spark.createDataFrame([("Anna Karina",), ("Ben",), ("Q",), ("Zed",)], "artist string")
    ean = spark.createDataFrame([(1, "anna"), (2, "karina"), (3, "ben"), (4, "AQ")], "row_number int, artist string")
    assert {(r["artist"], r["other"]) for r in B.artist_mismatches(isrc, ean).collect()} == {("anna karina", "anna"), ("q", "aq")}


def test_cross_layer_dedup(spark):
    rows = [
        (1, "artwork", "a", "too small"), (1, "metadata", "universal.artwork.x", "size"), (1, "metadata", "m", "Title is blank"), (1, "ddex", "d", "ISRC is bad"), (1, "metadata", "i", "must match ISO 3901"),
        (2, "metadata", "universal.artwork.x", "artwork size"), (2, "metadata", "s", '"My Song" is 30 seconds'), (2, "fraud", "f", "My song is under 60 seconds"), (2, "fraud", "f", "Other is under 60 seconds"), (2, "ddex", "d", "no publisher"), (2, "metadata", "p", "Publisher is required"),
    ]
    df = spark.createDataFrame(rows, "scan int, layer string, rule_id string, message string")
    gone = {(r["scan"], r["message"]) for r in O.cross_layer_dedup(df, "scan").where("duplicate").collect()}
    assert gone == {(1, "size"), (1, "must match ISO 3901"), (2, "My song is under 60 seconds"), (2, "Publisher is required")}


TRACKS = "array<struct<title:string,duration_ms:bigint,composer:string>>"


def test_fraud_rows(spark):
    rows = [
        (1, "Deep Sleep Lab", "Rain Sounds", None, None, [(f"Sleep {i}", 120_000, None) for i in range(6)]),
        (2, "Anna", "Songs", "Pub", "T1", [("A", 200_000, "x"), ("B", 30_000, "y"), ("C", 250_000, "z")]),
        (3, "Anna", "Songs", "Pub", "T1", [("Track 1", 200_000, "x"), ("B", 210_000, "y"), ("C", 250_000, "z")]),
        (4, "Anna", "Songs", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"release_id int, artist string, title string, publisher string, iswc string, tracks {TRACKS}")
    got = {(r["release_id"], r["signal_id"].split(".")[1], r["confidence"]) for r in D.lone_signals(df).collect()}
    assert got == {(1, "functional_music_spam", "high"), (1, "ai_generation_suspected", "high"), (2, "short_track_duration", "high"), (3, "generic_track_titles", "medium")}


def test_fraud_names_velocity_isrcs(spark):
    rel = spark.createDataFrame([(1, "Аdele"), (2, "Adelle"), (3, "Adele"), (4, "Nobody Known")], "release_id int, artist string")
    known = spark.createDataFrame([("Adele", 1)], "name string, pos int")
    got = {(r["release_id"], r["signal_id"].split(".")[1], r["confidence"]) for r in D.name_signals(rel, known).collect()}
    assert got == {(1, "homoglyph_artist_name", "high"), (2, "artist_name_similarity", "high")}
    many = spark.range(30).selectExpr("cast(id as int) release_id", "'a' artist", "'o' org_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) created_at")
    fast = D.velocity_signals(many).groupBy("signal_id", "confidence").count().collect()
    assert {(r["signal_id"].split("_")[-1], r["confidence"], r["count"]) for r in fast} == {("artist", "medium", 15), ("artist", "high", 10)}
    assert D.velocity_signals(many, ["o"]).count() == 0
    mine = spark.createDataFrame([(1, ["US-PR1-26-00001"]), (2, ["USPR12600002"])], "release_id int, isrc_list array<string>")
    corpus = spark.createDataFrame([("uspr12600001", 1), ("US-PR1-26-00001", 9), ("US-PR1-26-00002", 2)], "isrc string, release_id int")
    assert [(r["release_id"], r["other_id"]) for r in D.isrc_conflicts(mine, corpus).collect()] == [(1, 9)]


def test_media(spark):
    t = spark.createDataFrame([(1, "WAV", 44100, 16, -2.0, -14.0, 200), (2, "wma", 22050, 8, -0.5, -30.0, 30)], "id int, format string, sample_rate int, bit_depth int, true_peak double, loudness double, seconds int")
    got = {(r["id"], r["platform"], r["rule_id"]) for r in M.audio_findings(t, M.platform_table(spark), ["id"]).collect()}
    assert {x for x in got if x[0] == 1} == {(1, "youtube", "youtube.audio.sample_rate_too_low")}
    assert {x[2] for x in got if x[:2] == (2, "tiktok")} == {f"tiktok.audio.{x}" for x in ("format_not_accepted", "sample_rate_too_low", "bit_depth_too_low", "true_peak_exceeded", "loudness_too_quiet", "duration_too_short")}
    a = spark.createDataFrame([(1, "jpeg", 100, 4000, 4000, "RGB", 300.0), (2, None, 20_000_000, 1000, 2000, "CMYK", None)], "id int, format string, file_size_bytes long, width int, height int, color_mode string, dpi_x double")
    got = {(r["id"], r["rule_id"]) for r in M.artwork_findings(a, ["id"]).collect()}
    assert got == {(2, f"universal.artwork.{x}") for x in ("format_undetected", "file_size_too_large", "resolution_too_low", "not_square", "cmyk_color_space", "dpi_not_set")}
    assert one(spark, M.peak_dbfs(F.array(F.lit(0.5), F.lit(-1.0)))) == 0.0 and one(spark, M.peak_dbfs(F.array(F.lit(0.0)))) is None
    black, white, red = (F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for r, g, b in ((0, 0, 0), (255, 255, 255), (200, 10, 10)))
    assert one(spark, M.text_heavy(F.array(black, white))) and not one(spark, M.text_heavy(F.array(red, red)))


def test_enrichment(spark):
    t = spark.createDataFrame([(1, "Blue Moon", "Anna", "US-PR1-26-00001"), (2, "Zzz", "Qqq", "bad")], "id int, title string, artist string, isrc string")
    c = spark.createDataFrame([(1, "c1", 1, "Blue Moon", "Anna"), (1, "c0", 2, "Blue Noon", "Ann"), (2, "c2", 1, "Other", "Name")], "id int, candidate_id string, pos int, c_title string, c_artist string")
    assert [(r["id"], r["candidate_id"], r["confidence"]) for r in N.best_candidates(t, c, "id").collect()] == [(1, "c1", "high")]
    rec = spark.createDataFrame([("USPR12600001", "Something", "Anna")], "isrc string, r_title string, r_artist string")
    assert {r["id"]: r["status"] for r in N.isrc_lookup(t, rec, "id").collect()} == {1: "mismatch", 2: "invalid"}
    d = N.dictionary_match(t, spark.createDataFrame([("ANNA", "0000000121032683")], "name string, isni string"), spark.createDataFrame([("zzz", "T-1")], "title string, iswc string"))
    assert {r["id"]: (r["isni_display"], r["found_iswc"], r["enrichment_status"]) for r in d.collect()} == {1: ("0000 0001 2103 2683", None, "enriched"), 2: (None, "T-1", "enriched")}
