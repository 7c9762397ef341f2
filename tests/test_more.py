from pyspark.sql import functions as F

from tonearm.functions import identifiers as I
from tonearm.functions import similarity as Y
from tonearm.functions import text as X
from tonearm.operators import bulk as B
from tonearm.operators import fraud as D
from tonearm.operators import media as M
from tonearm.operators import scoring as S
from tonearm.sources import messages as G
from tonearm.sources import metadata as P
from tonearm.sources import stores as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names_compose_before_they_compare(spark):
    assert one(spark, X.normalize_artist(F.lit("Beyoncé  & Co"))) == one(spark, X.normalize_artist(F.lit("BEYONCÉ, co"))) == "beyoncé and co"
    assert one(spark, X.normalize_title(F.lit(None).cast("string"))) == ""


def test_small_text_functions(spark):
    got = spark.createDataFrame([("https://x.y/a/b.WAV?k=1.mp3",), ("https://x.y/a/b/",), ("https://x.y/file.toolong1",), ("f.mp3",)], "u string").select(X.url_extension(F.col("u"))).collect()
    assert [r[0] for r in got] == [".wav", ".bin", ".bin", ".mp3"]
    assert one(spark, X.safe_file_name(F.lit("a/b\\c d?.wav"))) == "c_d_.wav" and one(spark, X.safe_file_name(F.lit("x/"))) == "upload"
    assert len(one(spark, X.safe_title(F.lit("a b" * 40)))) == 60 and one(spark, X.safe_title(F.lit(None).cast("string"))) == "scan"
    assert bytes(one(spark, X.data_url_bytes(F.lit("data:text/plain;base64,aGk=")))) == b"hi" and one(spark, X.data_url_bytes(F.lit("http://x"))) is None
    dates = spark.createDataFrame([("1999",), ("2020-02-03T00:00:00",), ("20x0",), ("2020-13-01",), (None,)], "d string").select(I.release_date(F.col("d")).cast("string")).collect()
    assert [r[0] for r in dates] == ["1999-01-01", "2020-02-03", None, None, None]


def test_more_than_64_platforms_and_1000_definitions(spark):
    platforms = M.platform_table(spark, {f"p{i}": (["wav"], 16, 44100, [44100], -18.0, -9.0, -1.0, 0) for i in range(70)})
    tracks = spark.createDataFrame([(1, "mp3", 44100, 16, -2.0, -12.0, 100)], "id int, format string, sample_rate int, bit_depth int, true_peak double, loudness double, seconds int")
    assert M.audio_findings(tracks, platforms, ["id"]).select("platform").distinct().count() == 70
    definitions = spark.range(1200).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("signal_id"), F.lit("critical").alias("severity"), F.lit("hard_block").alias("resolution"), F.lit(False).alias("advisory"))
    out = D.with_definitions(definitions.select("signal_id", F.lit("low").alias("confidence")), definitions)
    assert out.where("severity = 'critical' and confidence = 'medium'").count() == 1200


def test_measured_audio(spark):
    t = spark.createDataFrame([(1, -0.5, 0.1, 3.0), (2, -1.0, None, None)], "id int, true_peak double, leading_silence double, trailing_silence double")
    assert sorted(r["rule_id"].split(".")[-1] for r in M.measured_findings(t, ["id"]).collect()) == ["silence_at_end", "true_peak_clipping"]
    probe = spark.createDataFrame([("a.FLAC", "wav", 0, 24, "flac"), ("a.bin", "w64,wav", None, None, "PCM_S24LE"), ("a", "mp3", 0, 0, "mp3")], "f string, p string, a int, b int, c string")
    assert [tuple(r) for r in probe.select(M.audio_format(F.col("f"), F.col("p")), M.bit_depth(F.col("a"), F.col("b"), F.col("c"))).collect()] == [("flac", 24), ("wav", 24), ("mp3", None)]


def test_velocity_equals_a_plain_count(spark):
    rows = [(i, "a" if i % 3 else "b", (i * 7919) % 9_000_000) for i in range(300)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "release_id int, artist string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r["release_id"]: r["n_recent"] for r in D.velocity(df, "artist", 7).collect()}
    assert got == {i: 1 if s is None else sum(1 for _, k2, s2 in rows if k2 == k and s2 is not None and s - 7 * 86400 <= s2 <= s) for i, k, s in rows}


def test_isrc_conflicts_equal_pairs(spark):
    lists = {1: ["US-AAA-20-00001", "usaaa2000002"], 2: ["USAAA2000001"], 3: ["USAAA2000001", "USAAA2000003"], 4: []}
    corpus = spark.createDataFrame([(i, x) for i, xs in lists.items() for x in xs] + [(None, "USAAA2000003")], "release_id int, isrc string")
    got = D.isrc_conflicts(spark.createDataFrame(list(lists.items()), "release_id int, isrc_list array<string>"), corpus).collect()
    assert sorted((r["release_id"], r["isrc"], r["other_id"]) for r in got) == [(1, "USAAA2000001", 2), (2, "USAAA2000001", 1), (3, "USAAA2000001", 1)]


def test_similar_names_of_frequent_and_short_names(spark):
    left = spark.createDataFrame([(i, "ab") for i in range(50)] + [(60, "x"), (61, "abba")], "id int, artist string")
    known = spark.createDataFrame([("abc", 1), ("y", 2), ("abba", 3)], "name string, pos int")
    out = Y.similar_names(left, known, "id", "artist", "name", "pos", 1).collect()
    assert sorted((r["id"], r["name"]) for r in out) == [(i, "abc") for i in range(50)] + [(60, "y")]


def test_artist_variant_findings(spark):
    history = spark.createDataFrame([(1, "A & B", "s", False), (1, "a and b", "s", False), (1, "C", "s", False), (2, "A, B", "s", True), (1, "c", None, False)], "org_id int, artist string, scan_id string, is_demo boolean")
    current = spark.createDataFrame([(1, 5, "e5", "A, B"), (1, 2, "e2", "A, B"), (1, 3, "e3", "C"), (2, 1, "e1", "A & B")], "org_id int, row_number int, ean string, artist string")
    got = B.artist_variant_findings(current, history).collect()
    assert [(r["row_number"], r["ean"], r["message"].split(": ")[1]) for r in got] == [(2, "e2", "A, B | A & B | a and b")]


def test_issue_lists_and_fields(spark):
    issues = spark.createDataFrame([(1, "R1", "info", "x"), (1, "R2", "critical", "y"), (2, "R3", "warning", "z"), (None, "R4", "critical", "w")], "row_number int, rule_id string, severity string, message string")
    releases = spark.createDataFrame([(1, "e", "A")], "row_number int, ean string, artist string")
    got = {r["row_number"]: (r["artist"], [i["rule_id"] for i in r["issues"]]) for r in S.issues_by_row(issues, releases).collect()}
    assert got == {1: ("A", ["R2", "R1"]), 2: (None, ["R3"])}
    rel = spark.createDataFrame([(1, "T", "", [("One", "I1"), ("", "I2")], 3000, 0)], "id int, title string, artist string, tracks array<struct<title:string,isrc:string>>, artwork_width int, artwork_height int")
    fields = S.validated_fields(rel, ["id"]).first()["fields"]
    assert [(f["label"], f["value"]) for f in fields] == [("Release Title", ["T"]), ("Track Count", ["2"]), ("ISRCs", ["I1, I2"]), ("Tracks", ["Track 1 — One — I1", "Track 2 — I2"])]


def test_track_upsert(spark):
    cols = "release_id int, track_number int, isrc string, title string, duration_ms long"
    old = spark.createDataFrame([(1, 1, "USAAA2000001", "One", 1), (1, 2, None, "Two", 2), (2, 1, "X", "Other", 3)], cols)
    new = spark.createDataFrame([(1, 3, "US-AAA-20-00001", "", 9), (1, 2, "USAAA2000002", "Zwei", 9), (1, 4, None, None, 9)], cols)
    got = sorted(tuple(r) for r in K.upsert_tracks(old, new).collect())
    assert got == [(1, 1, "USAAA2000001", "One", 1), (1, 2, "USAAA2000002", "Zwei", 2), (1, 4, None, "Unknown", 9), (2, 1, "X", "Other", 3)]


def test_lists_of_names_and_definitions(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# known\nAbba\n\n  Queen \n")
    assert [r["name"] for r in D.read_known_names(spark, str(tmp_path / "names.txt")).orderBy("pos").collect()] == ["Abba", "Queen"]
    (tmp_path / "s.yaml").write_text("signals:\n- id: a\n  severity: critical\n  resolution: hard_block\n  advisory: false\n- id: b\n")
    assert sorted(tuple(r) for r in D.read_definitions(spark, str(tmp_path / "s.yaml")).collect()) == [("a", "critical", "hard_block", False), ("b", "warning", "advisory", True)]


def test_messages_have_deals_and_versions():
    text = """<n:M xmlns:n="http://x/xml/ern/382" MessageSchemaVersionId="ern/382"><ReleaseList/><DealList><ReleaseDeal><DealReleaseReference>R0</DealReleaseReference><Deal><DealTerms>
    <CommercialModelType>SubscriptionModel</CommercialModelType><UseType>Stream</UseType><TerritoryCode>DE</TerritoryCode><ValidityPeriod><StartDate>2024-01-01</StartDate></ValidityPeriod></DealTerms></Deal></ReleaseDeal></DealList></n:M>"""
    m = G.parse_message(text)
    assert m["version"] == "ern/382" and m["deals"] == [{"release_reference": "R0", "commercial_model": "SubscriptionModel", "start_date": "2024-01-01", "end_date": None, "territory": "DE", "use_types": ["Stream"]}]
    assert G.parse_message("<x/>")["deals"] == [] and G.parse_message("<x")["error"]


def test_csv_json_and_xml_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<NewReleaseMessage xmlns='http://x/ern/41'><ReleaseList><Release IsMainRelease='true'><ICPN>0123456789012</ICPN><TitleText>T</TitleText></Release></ReleaseList></NewReleaseMessage>")
    files = spark.read.text(str(tmp_path / "a.xml"), wholetext=True).select(F.lit("a").alias("path"), F.col("value").alias("text"))
    row = files.select(G.parse_xml(F.col("text")).alias("m")).select("m.*").first()
    assert (row["upc"], row["title"], row["error"]) == ("0123456789012", "T", None)
    texts = spark.createDataFrame([("j", '[{"upc": "1", "title": "x", "tracks": [{"isrc": "A", "track_number": "2"}]}]'), ("bad", "{")], "path string, text string")
    out = {(r["path"], r["broken"]): r["tracks"] for r in P.releases_of_json(texts).collect()}
    assert out[("j", False)][0]["track_number"] == 2 and ("bad", True) in out
    filled = P.fill_aliases(spark.createDataFrame([("", "B", "U1")], "artist string, `Artist Name` string, barcode string"), {"artist": ["artist_name", "performer"], "upc": ["barcode"], "genre": ["style"]}).first()
    assert (filled["artist"], filled["upc"], filled["genre"]) == ("B", "U1", None)
