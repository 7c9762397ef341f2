"""Measures, names, dates and appended tables: operators that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..operators import bulk as B
from ..operators import media as M
from ..operators import scoring as S
from ..sources import stores as K
from ..sources import uploads as U
from . import tables as T


def file_names(spark, d):
    """Safe names, extensions of addresses, and payloads of data: URLs."""
    k = F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, (".JPG", "", ".jpeg?x=1.png", ".toolong", "/", ".tar.gz"))), (k % 6).cast("int") + 1)
    url = F.concat(F.lit("https://example.org/a.b/file"), k.cast("string"), ext)
    path = F.when(k % 4 == 0, F.lit("dir/")).otherwise(F.concat(F.lit("C:\\up loads\\été "), k.cast("string"), F.lit(" (1).csv")))
    data = F.when(k % 3 > 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.concat(F.lit("p"), k.cast("string")).cast("binary")))).otherwise(url)
    return T.load(spark, d, "pages").select(k, X.url_extension(url).alias("extension"), X.safe_file_name(path).alias("name"), X.data_url_bytes(data).cast("string").alias("payload"))


def release_dates(spark, d):
    """Dates from whole dates, years alone, and what is neither."""
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy"), F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00")), F.lit("2020-13-45"), F.lit("soon"), F.lit("20")), (k % 6).cast("int") + 1)
    return T.load(spark, d, "orders").select(k, F.date_format(I.release_date(raw), "yyyy-MM-dd").alias("parsed"))


def media_measures(spark, d):
    """Clipping and silence of each track, its format by name or probe, and its bits."""
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int") + 1)
    t = T.load(spark, d, "part").select(k, (F.col("p_size") / -20.0).cast("double").alias("true_peak"), (k % 7 / 2.0).cast("double").alias("leading_silence"), (k % 5).cast("double").alias("trailing_silence"), pick(k, "a.WAV", "b.txt", "c", "d.m4a").alias("file_name"), pick(k, "w64,wav", "mpeg", "ipod,mov", "weird", None).alias("probed"), pick(k, None, "24", "0").alias("bits"), pick(k, "PCM_S16LE", "mp3", "pcm_f32be").alias("codec"))
    found = M.measured_findings(t, ["p_partkey"]).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("rule_id")), "|").alias("rules"))
    return t.join(found, "p_partkey", "left").select("p_partkey", M.audio_format(F.col("file_name"), F.col("probed")).alias("format"), M.bit_depth(F.col("bits"), F.lit(None).cast("string"), F.col("codec")).alias("bits"), F.coalesce("rules", F.lit("")).alias("rules"))


def validated_fields(spark, d):
    k = F.col("p_partkey")
    track = lambda n: F.struct(F.when(k % n > 0, F.col("p_type")).otherwise("").alias("title"), F.when(k % (n + 1) > 0, F.concat(F.lit("I"), k.cast("string"))).otherwise("").alias("isrc"))
    r = T.load(spark, d, "part").select(k, F.col("p_name").alias("title"), F.when(k % 3 > 0, F.col("p_brand")).otherwise("").alias("artist"), F.when(k % 4 > 0, F.array(track(2), track(3))).otherwise(F.array().cast("array<struct<title:string,isrc:string>>")).alias("tracks"), (F.col("p_size") * 100).alias("artwork_width"), F.when(k % 5 > 0, 3000).otherwise(0).alias("artwork_height"))
    shown = F.transform("fields", lambda f: F.concat(f["label"], F.lit("="), F.array_join(f["value"], "; "), F.lit("/"), f["format"]))
    return S.validated_fields(r, ["p_partkey"]).select("p_partkey", F.array_join(shown, "|").alias("fields"))


def variant_findings(spark, d):
    """Artists of new rows that history spells in several ways."""
    k = F.col("p_partkey")
    p = T.load(spark, d, "part").withColumn("org_id", k % 4)
    history = p.select("org_id", F.when(k % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("artist"), F.when(k % 17 > 0, k).alias("scan_id"), (k % 19 == 0).alias("is_demo"))
    current = p.where(k % 2 == 0).select("org_id", k.cast("int").alias("row_number"), F.lpad(k.cast("string"), 13, "0").alias("ean"), F.concat(F.lit(" "), "p_brand").alias("artist"))
    return B.artist_variant_findings(current, history).select("org_id", "row_number", "ean", "artist_normalized", "message")


def score_variants(spark, d):
    """Scores where errors count as criticals, and where infos don't count."""
    r = T.results(spark, d).withColumn("severity", F.when(F.col("line") % 3 == 0, "error").otherwise(F.col("severity")))
    a = S.readiness(r, ["scan_id"], error_as="critical").select("scan_id", F.col("critical_count").alias("with_errors"), F.col("score").alias("strict_score"))
    return a.join(S.readiness(r, ["scan_id"], with_info=False).select("scan_id", F.col("score").alias("bulk_score")), "scan_id")


def appended_results(spark, d):
    """Results appended in two halves, by organisation, and read back."""
    r = T.results(spark, d).select("scan_id", "line", "severity", (F.col("partkey") % 5).alias("org_id"))
    path = U.shared_folder(spark, "results")
    for half in (0, 1):
        K.append(r.where(F.col("scan_id") % 2 == half), path, ["org_id"])
    return spark.read.parquet(path).select("scan_id", "line", "severity", F.col("org_id").cast("long").alias("org_id"))


def release_exports(spark, d):
    """Releases exported as CSV and read back."""
    c = T.load(spark, d, "customer")
    r = c.select(F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, ', "live"').otherwise("")).alias("title"), F.col("c_mktsegment").alias("artist"), F.col("c_custkey").cast("string").alias("upc"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"))
    path = U.shared_folder(spark, "export")
    K.export_releases(r, path)
    return spark.read.csv(path, header=True, escape='"').select("title", "artist", "upc")


def signed(spark, d):
    """Signatures of payloads."""
    e = T.load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("body"))
    return e.select("s_suppkey", K.hmac_sha256("key")(F.col("body")).alias("signature"))


_PAD = lambda x: bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex()  # noqa: E731  the two pads of HMAC
_TRACK = "CASE WHEN p_partkey % {n} > 0 THEN p_type ELSE '' END AS t{n}, CASE WHEN p_partkey % {m} > 0 THEN 'I' || p_partkey ELSE '' END AS i{n}"

QUERIES = {
    "file_names": (file_names, r"""SELECT page_id, ['.jpg', '.bin', '.jpeg', '.bin', '.bin', '.gz'][(page_id % 6)::INT + 1] AS extension, CASE WHEN page_id % 4 = 0 THEN 'upload' ELSE 'été_' || page_id || '__1_.csv' END AS name, CASE WHEN page_id % 3 > 0 THEN 'p' || page_id END AS payload FROM pages"""),
    "release_dates": (release_dates, """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders"""),
    "media_measures": (media_measures, """WITH t AS (SELECT p_partkey AS k, p_size / -20.0::DOUBLE AS peak FROM part) SELECT k AS p_partkey, CASE k % 4 WHEN 0 THEN 'wav' WHEN 3 THEN 'm4a' ELSE ['wav', 'mp3', 'm4a', 'weird', NULL][(k % 5)::INT + 1] END AS format, CASE k % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 32 END::INT AS bits,
        concat_ws('|', CASE WHEN k % 7 / 2.0 > 2 THEN NULL END, CASE WHEN k % 5 > 2 THEN 'universal.audio.silence_at_end' END, CASE WHEN k % 7 / 2.0 > 2 THEN 'universal.audio.silence_at_start' END, CASE WHEN peak > -1 THEN 'universal.audio.true_peak_clipping' END) AS rules FROM t"""),
    "validated_fields": (validated_fields, f"""WITH p AS (SELECT *, {_TRACK.format(n=2, m=3)}, {_TRACK.format(n=3, m=4)}, p_partkey % 4 > 0 AS has FROM part)
        SELECT p_partkey, concat_ws('|', 'Release Title=' || p_name || '/text', CASE WHEN p_partkey % 3 > 0 THEN 'Artist=' || p_brand || '/text' END, CASE WHEN has THEN 'Track Count=2/text' END, CASE WHEN has AND i2 || i3 <> '' THEN 'ISRCs=' || concat_ws(', ', nullif(i2, ''), nullif(i3, '')) || '/text' END,
        CASE WHEN has THEN 'Tracks=' || concat_ws(' — ', 'Track 1', nullif(t2, ''), nullif(i2, '')) || '; ' || concat_ws(' — ', 'Track 2', nullif(t3, ''), nullif(i3, '')) || '/list' END, CASE WHEN p_size > 0 AND p_partkey % 5 > 0 THEN 'Artwork=' || p_size * 100 || '×3000 px/text' END) AS fields FROM p"""),
    "variant_findings": (variant_findings, """WITH h AS (SELECT DISTINCT p_partkey % 4 AS org_id, lower(p_brand) AS n, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS artist FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 19 <> 0), g AS (SELECT org_id, n, list_sort(list(artist)) AS v FROM h GROUP BY ALL HAVING count(*) > 1),
        c AS (SELECT p_partkey % 4 AS org_id, lower(p_brand) AS n, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS brand FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
        SELECT org_id, k::INT AS row_number, lpad(k::VARCHAR, 13, '0') AS ean, n AS artist_normalized, 'artist is spelled in several ways: ' || array_to_string(([' ' || brand] || v)[1:4], ' | ') AS message FROM c JOIN g USING (org_id, n)"""),
    "score_variants": (score_variants, f"""WITH {T.RESULTS}, c AS (SELECT scan_id, count(*) FILTER (WHERE l AND s IN ('critical', 'error')) AS e, count(*) FILTER (WHERE l AND s = 'critical') AS c, count(*) FILTER (WHERE l AND s = 'warning') AS w, count(*) FILTER (WHERE l AND s = 'info') AS i FROM (SELECT scan_id, NOT resolved AND layer <> 'enrichment' AS l, CASE WHEN line % 3 = 0 THEN 'error' ELSE severity END AS s FROM results) GROUP BY 1)
        SELECT scan_id, e AS with_errors, round_even(greatest(0, 100 - least(e * 10.0, 60) - least(w * 3.0, 25) - least(i * 0.5, 5)), 1)::DOUBLE AS strict_score, round_even(greatest(0, 100 - least(c * 10.0, 60) - least(w * 3.0, 25)), 1)::DOUBLE AS bulk_score FROM c"""),
    "appended_results": (appended_results, f"WITH {T.RESULTS} SELECT scan_id, line, severity, partkey % 5 AS org_id FROM results"),
    "release_exports": (release_exports, """SELECT c_name || CASE WHEN c_custkey % 7 = 0 THEN ', "live"' ELSE '' END AS title, c_mktsegment AS artist, c_custkey::VARCHAR AS upc FROM customer"""),
    "signed": (signed, f"SELECT s_suppkey, 'sha256=' || sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(s_name)))) AS signature FROM supplier"),
}
