"""Checks of identifiers, names, media and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import layout as L
from ..functions import identifiers as I
from ..functions import similarity as Y
from ..functions import text as X
from ..operators import bulk as B
from ..operators import fraud as D
from ..operators import media as M
from ..plans import rules as R
from ..plans.ruleset import RULES
from ..schema import with_release_defaults
from . import tables as T

#: A day to judge by, as queries must not depend on the clock.
TODAY = "1998-08-02"


def ean_check_digit(spark, d):
    c = T.load(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "4").alias("body"))
    ean = F.when(F.col("c_custkey") % 3 == 0, F.concat("body", I.ean_check_digit(F.col("body")).cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat("body", F.lit("5"))).otherwise(F.concat("body", F.lit("x")))
    return c.select("c_custkey", ean.alias("ean")).select("c_custkey", "ean", I.ean_check_digit(F.col("ean")).alias("digit"), I.ean_problem(F.col("ean")).alias("problem"))


def mmddyy_parse(spark, d):
    o = T.load(spark, d, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 31 % 1000000).cast("string"), 6, "0").alias("raw"))
    return o.select("o_orderkey", "raw", F.date_format(I.mmddyy(F.col("raw")), "yyyy-MM-dd").alias("parsed"))


def bulk_row_checks(spark, d):
    s = T.load(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(
        k.cast("int").alias("row_number"), F.lpad(k.cast("string"), 13, "0").alias("ean"), F.when(k % 9 > 0, F.col("s_name")).alias("artist"), F.when(k % 8 > 0, F.col("s_name")).otherwise("  ").alias("title"),
        F.when(k % 5 > 0, F.lpad((k * 97 % 130000).cast("string"), 6, "0")).otherwise("1x2y98").alias("release_date_raw"), F.when(k % 4 == 0, F.lit("Imp")).alias("imprint"), F.when(k % 6 == 0, F.lit("Lab")).alias("label"),
        F.lpad((k % 60).cast("string"), 2, "0").alias("narm_config"), F.when(k % 3 == 0, F.lit("AB!")).when(k % 3 == 1, F.lit("ABCDEFGHIJKLM")).alias("label_abbreviation"),
        F.when(k % 4 == 0, F.lit("us")).when(k % 4 == 1, F.lit("ZZ")).when(k % 4 == 2, F.lit("USA")).alias("country_code"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 16, "0")).when(k % 5 == 0, F.lit("000000000000000X")).alias("isni"),
        F.when(k % 2 == 1, F.concat(F.lit("T"), F.lpad(k.cast("string"), 10, "0"))).when(k % 3 == 0, F.lit("T-000.000.001-0")).alias("iswc"),
    )
    return B.check_releases(rows, ["DE", "ES", "FR", "GB", "US"], F.lit("2010-01-01").cast("date")).select("row_number", "rule_id", "severity")


def isrc_format(spark, d):
    p = T.load(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("us-pr1-26-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("GBABC"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).otherwise(F.lit("INVALID-ISRC-007")).alias("isrc"))
    return p.select("p_partkey", "isrc", I.isrc_key(F.col("isrc")).alias("isrc_key"), I.isrc_valid(F.col("isrc")).alias("valid"))


def duration_parse(spark, d):
    li = T.load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("PT"), (F.col("o_orderkey") % 60).cast("string"), F.lit("M"), (F.col("o_orderkey") % 59).cast("string"), F.lit("S")).alias("iso"), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")).alias("mmss"))
    return li.select("o_orderkey", I.iso_duration_ms(F.col("iso")).alias("iso_ms"), I.mmss_ms(F.col("mmss")).alias("mmss_ms"))


def artist_similarity(spark, d):
    c = T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.regexp_replace("c_name", "#0*", " ")).alias("artist"))
    known = T.load(spark, d, "supplier").select(F.concat(F.lit("customer "), (F.col("s_suppkey") * 37).cast("string")).alias("name"), F.col("s_suppkey").alias("pos"))
    return Y.similar_names(c, known, "id", "artist", "name", "pos", 1).select("id", "artist", "name", "distance")


def keyword_spam(spark, d):
    t = T.load(spark, d, "conversations").select("conv_id", "turn", "text")
    return t.select("conv_id", "turn", F.array_join(X.words_found(F.col("text"), ("the", "and", "ing", "relax", "zen")), "|").alias("found"))


def generic_titles(spark, d):
    e = T.load(spark, d, "events")
    title = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Track "), (F.col("event_id") % 12).cast("string"))).when(F.col("event_id") % 4 == 1, F.lit("untitled")).when(F.col("event_id") % 4 == 2, F.concat("event_type", F.lit(" "), (F.col("event_id") % 7).cast("string"))).otherwise(F.col("event_type"))
    g = e.select("user_id", title.alias("title")).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(X.generic_title(F.col("title"))).alias("generic"))
    return g.withColumn("share", F.round(F.col("generic").cast("double") / F.col("n"), 4))


def formulaic_titles(spark, d):
    li = T.load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("Sleep Music "), F.col("l_linenumber").cast("string"))).otherwise(F.concat("l_returnflag", F.lit(" 1"))).alias("title"))
    return li.groupBy("l_orderkey").agg(F.collect_list("title").alias("t")).select("l_orderkey", X.formulaic_titles(F.col("t")).cast("long").alias("formulaic"))


def uniform_duration(spark, d):
    li = T.load(spark, d, "lineitem").select("l_orderkey", F.struct((F.col("l_quantity") * 1000).cast("long").alias("duration_ms")).alias("t"))
    return li.groupBy("l_orderkey").agg(F.collect_list("t").alias("t")).select("l_orderkey", F.coalesce(D.uniform_duration(F.col("t")), F.lit(False)).alias("uniform"))


def homoglyph_fold(spark, d):
    s = T.load(spark, d, "customer").select("c_custkey", F.translate("c_name", "aeoC", "аеоС").alias("name"))
    return s.select("c_custkey", X.fold_lookalikes(F.col("name")).alias("folded"), X.has_lookalikes(F.col("name")).alias("odd"))


def normalize_artist(spark, d):
    p = T.load(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.when(F.col("p_partkey") % 3 == 0, " & Co").when(F.col("p_partkey") % 3 == 1, ", Crew").otherwise("  feat. X"), F.lit(" ")).alias("artist"))
    return p.select("p_partkey", X.normalize_artist(F.col("artist")).alias("normalized"))


def isrc_conflicts(spark, d):
    li = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.concat(F.lit("US-PR1-26-"), F.lpad((F.col("l_partkey") * 7 % 99999).cast("string"), 5, "0")).alias("isrc"))
    mine = li.groupBy("release_id").agg(F.collect_list("isrc").alias("isrc_list"))
    return D.isrc_conflicts(mine, li)


def release_velocity(spark, d):
    r = T.scans(spark, d).select(F.col("scan_id").alias("release_id"), F.col("release_id").alias("artist"), "created_at")
    return D.velocity(r, "artist", 30).select("release_id", "n_recent")


def fraud_signals(spark, d):
    li = T.load(spark, d, "lineitem")
    track = F.struct("l_linenumber", F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.lit("Rain Sounds "), F.col("l_linenumber").cast("string"))).otherwise(F.col("l_shipdate").cast("string")).alias("title"), (F.col("l_quantity") * 10000).cast("long").alias("duration_ms"), F.when(F.col("l_orderkey") % 3 > 0, F.lit("someone")).alias("composer"))
    rel = li.groupBy(F.col("l_orderkey").alias("release_id")).agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    rel = rel.select("release_id", "tracks", F.when(F.col("release_id") % 2 == 0, "Deep Sleep Lab").otherwise("Anna").alias("artist"), F.when(F.col("release_id") % 5 == 0, "Calm Nights").otherwise("Songs").alias("title"), F.when(F.col("release_id") % 7 == 0, "made with Suno").alias("publisher"), F.lit(None).cast("string").alias("iswc"))
    return D.lone_signals(rel).select("release_id", "signal_id", "confidence")


def _pick(k, *values):
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def _records(spark, d):
    p = L.spread(T.load(spark, d, "part"), 20_000)  # each gives some seventy rows
    k = F.col("p_partkey")
    return with_release_defaults(p.select(
        k, F.concat("p_name", _pick(k, " (Live)", " (feat. X)", "", "", "", "", "")).alias("title"), F.when(k % 4 > 0, F.col("p_brand")).alias("artist"), F.lpad(k.cast("string"), F.when(k % 2 == 0, 12).otherwise(11), F.lit("7")).alias("upc"),
        F.when(k % 3 == 0, F.array(F.lit("US-PR1-26-00001"), F.lit("US-PR1-26-00001"))).when(k % 3 == 1, F.array(F.lit("GBABC2600001"), F.lit("bad"))).alias("isrc_list"),
        (F.col("p_size") * 100).alias("artwork_width"), F.lit(3000).alias("artwork_height"), F.when(k % 5 == 0, "gif").otherwise("png").alias("artwork_format"), _pick(k, "8/2/98", "", "1998-08-02", "1998-08-02", "1998-03-02", "1998-08-02").alias("release_date"),
        _pick(k, 44100, 22050, 96000).alias("sample_rate"), (F.col("p_size") / -10.0).cast("double").alias("true_peak_dbtp"), (F.col("p_size") / -2.0).cast("double").alias("loudness_lufs"), _pick(k, 0, 8, 16, 24).alias("bit_depth"),
        F.when(k % 9 > 0, "L").otherwise("  ").alias("label"), F.when(k % 10 > 0, "Pop").alias("genre"), _pick(k, "", "Explicit", "Not Explicit", "Clean", "X").alias("parental_warning"), F.when(k % 2 > 0, "P").alias("publisher"),
        F.when(k % 3 > 0, "2020 P").alias("p_line"), F.when(k % 4 > 0, "2020 C").alias("c_line"), _pick(k, "en", "EN", "", "deu").alias("language"), F.when(k % 6 > 0, "Worldwide").alias("territory"),
        _pick(k, "", "1998-01-01", "1998-05-01", "1998-08-02", "1998-12-01").alias("preorder_date"), (k % 100).cast("int").alias("preview_start_time"), _pick(k, "", "RGB", "CMYK").alias("artwork_color_mode"),
    ))


def rule_eval(spark, d):
    return R.evaluate(_records(spark, d), RULES, ["p_partkey"]).where("status <> 'skip'").select("p_partkey", "rule_id", "status")


def rule_eval_skip(spark, d):
    return R.evaluate(_records(spark, d), RULES, ["p_partkey"]).where("status = 'skip'").select("p_partkey", "rule_id", "severity", "message")


def audio_thresholds(spark, d):
    p = T.load(spark, d, "part")
    k = F.col("p_partkey")
    t = p.select(k, F.when(k % 4 == 0, "wav").when(k % 4 == 1, "mp3").when(k % 4 == 2, "aiff").otherwise("wma").alias("format"), F.when(k % 3 == 0, 44100).when(k % 3 == 1, 48000).otherwise(22050).alias("sample_rate"), F.when(k % 2 == 0, 16).otherwise(8).alias("bit_depth"), (F.col("p_size") / -20.0).cast("double").alias("true_peak"), (F.col("p_size") / -2.0).cast("double").alias("loudness"), (F.col("p_size") * 5).alias("seconds"))
    return M.audio_findings(t, M.platform_table(spark), ["p_partkey"]).select("p_partkey", "platform", "rule_id", "severity")


def artwork_checks(spark, d):
    p = T.load(spark, d, "part")
    k = F.col("p_partkey")
    art = p.select(k, F.when(k % 4 == 0, "gif").when(k % 4 < 3, "jpeg").alias("format"), (F.col("p_size") * 400000).cast("long").alias("file_size_bytes"), (F.col("p_size") * 100).alias("width"), (F.when(k % 2 == 0, F.col("p_size") * 100).otherwise(3500)).alias("height"), F.when(k % 5 == 0, "CMYK").when(k % 5 == 1, "L").otherwise("RGB").alias("color_mode"), F.when(k % 3 > 0, (k % 400).cast("double")).alias("dpi_x"))
    return M.artwork_findings(art, ["p_partkey"]).select("p_partkey", "rule_id", "severity")


def peak_dbfs(spark, d):
    return T.load(spark, d, "embeddings").select("vec_id", M.peak_dbfs(F.col("embedding")).alias("peak"))


def rule_label(spark, d):
    s = T.load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("universal.metadata."), F.lower(F.replace("s_name", F.lit("#"), F.lit("_")))).alias("rule_id"))
    return s.select("s_suppkey", X.rule_label(F.col("rule_id")).alias("label"))


def sha_keys(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2(F.concat(F.lit("key"), F.col("doc_id").cast("string")), 256), 1, 8).alias("prefix"))


def _in(words: str, column: str) -> str:
    return f"contains(lower({column}), '{words}')"


_EAN = "(10 - (list_sum([substr(ean, i, 1)::INT * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) for i in range(1, 13)]) % 10)) % 10"
_REC = """r AS (SELECT p_partkey, p_name || [' (Live)', ' (feat. X)', '', '', '', '', ''][(p_partkey % 7)::INT + 1] AS title, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS artist, lpad(p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 11 END, '7') AS upc,
 CASE p_partkey % 3 WHEN 0 THEN ['US-PR1-26-00001','US-PR1-26-00001'] WHEN 1 THEN ['GBABC2600001','bad'] ELSE [] END AS isrcs, p_size * 100 AS w, CASE WHEN p_partkey % 5 = 0 THEN 'gif' ELSE 'png' END AS fmt,
 ['8/2/98', '', '1998-08-02', '1998-08-02', '1998-03-02', '1998-08-02'][(p_partkey % 6)::INT + 1] AS rd, [44100, 22050, 96000][(p_partkey % 3)::INT + 1] AS sr, p_size / -10.0::DOUBLE AS tp, p_size / -2.0::DOUBLE AS lufs, [0, 8, 16, 24][(p_partkey % 4)::INT + 1] AS bits,
 ['', 'Explicit', 'Not Explicit', 'Clean', 'X'][(p_partkey % 5)::INT + 1] AS pw, ['', '1998-01-01', '1998-05-01', '1998-08-02', '1998-12-01'][(p_partkey % 5)::INT + 1] AS pre FROM part)"""
_LABEL, _GENRE, _PW, _PW_OK, _PEAK, _LUFS = "p_partkey % 9 > 0", "p_partkey % 10 > 0", "pw <> ''", "pw IN ('', 'Explicit', 'Clean')", "tp = 0 OR tp <= -1.0", "lufs = 0 OR lufs BETWEEN -16 AND -12"
_UPC, _ANY_ISRC, _SIDES, _RGB, _RATES, _LANG = "regexp_full_match(upc, '[0-9]{12,13}')", "len(isrcs) > 0", "w = 0 OR w >= 3000", "p_partkey % 3 < 2", "sr IN (44100, 48000)", "p_partkey % 4 IN (0, 2)"
_RULES = {
    "universal.metadata.upc_format": _UPC, "universal.metadata.isrc_present": _ANY_ISRC, "universal.metadata.isrc_format": "len(isrcs) > 0 AND NOT list_contains(isrcs, 'bad')", "universal.metadata.isrc_unique": "len(isrcs) = len(list_distinct(isrcs))",
    "universal.metadata.release_title_required": "trim(title) <> ''", "universal.metadata.artist_name_required": "artist <> ''", "universal.metadata.genre_required": _GENRE, "universal.metadata.label_required": _LABEL,
    "universal.metadata.release_date_required": "rd <> ''", "universal.metadata.release_date_format": "rd = '' OR rd LIKE '____-__-__'", "universal.audio.sample_rate_minimum": "sr >= 44100", "universal.audio.bit_depth_minimum": "bits <> 8",
    "universal.artwork.minimum_resolution": _SIDES, "universal.artwork.must_be_square": "w IN (0, 3000)", "universal.artwork.format_must_be_jpeg_or_png": "fmt = 'png'",
    "spotify.metadata.contributor_publisher_required": "p_partkey % 2 = 1", "spotify.metadata.explicit_content_flag": _PW, "spotify.metadata.explicit_flag_valid_value": _PW_OK, "spotify.metadata.track_title_no_version_in_main": "p_partkey % 7 > 1",
    "spotify.metadata.p_line_year_required": "p_partkey % 3 > 0", "spotify.metadata.c_line_required": "p_partkey % 4 > 0", "spotify.metadata.label_name_required": _LABEL, "spotify.metadata.language_code_valid": _LANG,
    "spotify.audio.preferred_sample_rate": _RATES, "spotify.audio.loudness_target": _LUFS, "spotify.audio.true_peak_limit": _PEAK, "spotify.artwork.preferred_resolution": "w = 0 OR w >= 3000",
    "apple.metadata.advisory_rating_required": _PW, "apple.metadata.advisory_rating_valid_value": "pw <> 'X'", "apple.metadata.genre_must_be_apple_genre": _GENRE, "apple.metadata.territory_rights_specified": "p_partkey % 6 > 0",
    "apple.metadata.preorder_date_before_release_date": "pre = '' OR rd = '' OR pre < rd", "apple.metadata.preview_start_time_in_range": "p_partkey % 100 <= 60", "apple.metadata.c_line_required": "p_partkey % 4 > 0", "apple.metadata.p_line_required": "p_partkey % 3 > 0",
    "apple.audio.loudness_target": "lufs = 0 OR lufs BETWEEN -18 AND -14", "apple.artwork.rgb_color_space_required": _RGB,
    "youtube.metadata.isrc_required_for_content_id": _ANY_ISRC, "youtube.metadata.content_advisory_required": _PW, "youtube.metadata.upc_required": _UPC, "youtube.metadata.language_code_valid": _LANG, "youtube.metadata.genre_required": _GENRE,
    "youtube.metadata.label_required": _LABEL, "youtube.audio.preferred_sample_rate": _RATES, "youtube.audio.loudness_target": _LUFS, "youtube.artwork.rgb_color_space": _RGB, "youtube.artwork.format_jpeg_preferred": "fmt = 'png'",
    "amazon.metadata.isrc_required": _ANY_ISRC, "amazon.metadata.explicit_flag_required": _PW, "amazon.metadata.explicit_flag_valid": _PW_OK, "amazon.metadata.genre_required": _GENRE, "amazon.metadata.label_required": _LABEL, "amazon.metadata.c_line_required": "p_partkey % 4 > 0",
    "amazon.metadata.p_line_required": "p_partkey % 3 > 0", "amazon.audio.hd_bit_depth": "bits <> 8", "amazon.audio.true_peak_limit": _PEAK, "amazon.audio.loudness_target": _LUFS, "amazon.artwork.rgb_color_space": _RGB,
    "tiktok.metadata.isrc_required": _ANY_ISRC, "tiktok.metadata.explicit_flag_required": _PW, "tiktok.metadata.explicit_flag_valid": _PW_OK, "tiktok.metadata.genre_recommended": _GENRE, "tiktok.metadata.label_required": _LABEL,
    "tiktok.audio.preferred_sample_rate": _RATES, "tiktok.audio.loudness_target": _LUFS, "tiktok.audio.true_peak_limit": _PEAK, "tiktok.artwork.minimum_resolution": _SIDES, "tiktok.artwork.rgb_color_space": _RGB, "tiktok.artwork.must_be_square": "w IN (0, 3000)",
}
_BY_HAND = [
    ("universal.metadata.release_date_not_in_past", "warning"), ("universal.audio.duration_mismatch", "warning"), ("universal.audio.silence_at_start", "info"), ("universal.artwork.no_text_overlay", "warning"), ("spotify.artwork.no_spotify_logo", "critical"),
    ("apple.metadata.iswc_recommended", "info"), ("apple.audio.lossless_preferred", "info"), ("apple.audio.dolby_atmos_channel_check", "warning"), ("apple.artwork.no_apple_logo", "critical"), ("amazon.audio.ultra_hd_preferred", "info"),
    ("tiktok.metadata.artist_image_url_recommended", "info"), ("tiktok.audio.minimum_duration", "warning"),
]
_PLAT = "plat(platform, formats, min_bits, min_rate, rates, low, high, peak, min_seconds) AS (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {v[4]}::DOUBLE, {v[5]}::DOUBLE, {v[6]}::DOUBLE, {v[7]})" for k, v in M.PLATFORMS.items()) + ")"
_AUDIO = [("format_not_accepted", "critical", "NOT list_contains(formats, format)"), ("sample_rate_too_low", "critical", "sample_rate < min_rate"), ("sample_rate_not_preferred", "info", "sample_rate >= min_rate AND NOT list_contains(rates, sample_rate)"), ("bit_depth_too_low", "critical", "bit_depth < min_bits"), ("true_peak_exceeded", "critical", "true_peak <> 0 AND true_peak > peak"), ("loudness_too_quiet", "warning", "loudness <> 0 AND loudness < low"), ("loudness_too_loud", "warning", "loudness <> 0 AND loudness > high"), ("duration_too_short", "warning", "min_seconds > 0 AND seconds < min_seconds")]
_ART = [("format_undetected", "critical", "format IS NULL"), ("format_not_accepted", "critical", "format NOT IN ('jpeg', 'png')"), ("file_size_too_large", "critical", "bytes > 10485760"), ("resolution_too_low", "critical", "least(w, h) < 3000"), ("resolution_below_recommended", "info", "least(w, h) >= 3000 AND least(w, h) < 4000"), ("not_square", "critical", "abs(w::DOUBLE / h - 1) > 0.01"), ("cmyk_color_space", "critical", "mode = 'CMYK'"), ("grayscale_color_mode", "warning", "mode = 'L'"), ("dpi_not_set", "info", "dpi IS NULL"), ("dpi_too_low", "warning", "dpi < 72"), ("dpi_below_recommended", "info", "dpi >= 72 AND dpi < 300")]


def _any(cases, source: str, columns: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {columns}'{rule}' AS rule_id, '{severity}' AS severity FROM {source} WHERE {where}" for rule, severity, where in cases)


_K = "s_suppkey"
_ROW_CHECKS = [
    ("BULK_EAN_FORMAT", "critical", f"ean NOT SIMILAR TO '[0-9]{{13}}' OR k = 0 OR substr(ean, 13, 1)::INT <> {_EAN}"), ("BULK_ARTIST_MISSING", "warning", "artist IS NULL"), ("BULK_TITLE_MISSING", "warning", "trim(title) = ''"),
    ("BULK_DATE_FORMAT", "critical", "d IS NULL"), ("BULK_DATE_FORMAT", "warning", "d < DATE '2008-01-01'"), ("BULK_IMPRINT_MISSING", "warning", "k % 4 <> 0 AND k % 6 <> 0"), ("BULK_LABEL_ABBR_INVALID", "warning", "k % 3 < 2"),
    ("BULK_COUNTRY_CODE_INVALID", "warning", "k % 4 IN (1, 2)"), ("BULK_COUNTRY_CODE_MISSING", "info", "k % 4 = 3"), ("BULK_NARM_UNKNOWN", "warning", f"lpad((k % 60)::VARCHAR, 2, '0') NOT IN {tuple(B.NARM_CODES)}"),
    ("BULK_ISNI_FORMAT", "warning", "k = 0 OR (k % 2 = 1 AND k % 5 = 0)"), ("BULK_ISNI_MISSING", "info", "k % 2 = 1 AND k % 5 <> 0"), ("BULK_ISWC_FORMAT", "warning", "k % 2 = 0 AND k % 3 = 0"), ("BULK_ISWC_MISSING", "info", "k % 2 = 0 AND k % 3 <> 0"),
    ("BULK_DATE_FUTURE", "info", "d > DATE '2010-01-01' + 183"),
]

QUERIES = {
    "ean_check_digit": (ean_check_digit, f"""WITH c AS (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 12, '4') AS ean FROM customer), x AS (SELECT c_custkey, ean || CASE c_custkey % 3 WHEN 0 THEN ({_EAN})::VARCHAR WHEN 1 THEN '5' ELSE 'x' END AS ean FROM c)
        SELECT c_custkey, ean, ({_EAN})::INT AS digit, CASE WHEN ean LIKE '%x' THEN 'not digits' WHEN substr(ean, 13, 1)::INT <> {_EAN} THEN 'check digit' END AS problem FROM x"""),
    "mmddyy_parse": (mmddyy_parse, """WITH o AS (SELECT o_orderkey, lpad((o_orderkey * 31 % 1000000)::VARCHAR, 6, '0') AS raw FROM orders)
        SELECT o_orderkey, raw, strftime(try_strptime('20' || raw, '20%m%d%y'), '%Y-%m-%d') AS parsed FROM (SELECT o_orderkey, raw FROM o) WHERE true""".replace("try_strptime('20' || raw, '20%m%d%y')", "try_strptime(substr(raw, 1, 4) || '20' || substr(raw, 5, 2), '%m%d%Y')")),
    "label_country_checks": (bulk_row_checks, f"""WITH s AS (SELECT s_suppkey AS k, lpad(s_suppkey::VARCHAR, 13, '0') AS ean, CASE WHEN s_suppkey % 9 > 0 THEN s_name END AS artist, CASE WHEN s_suppkey % 8 > 0 THEN s_name ELSE '  ' END AS title,
        CASE WHEN s_suppkey % 5 > 0 THEN lpad((s_suppkey * 97 % 130000)::VARCHAR, 6, '0') ELSE '1x2y98' END AS raw FROM supplier), r AS (SELECT *, try_strptime(substr(raw, 1, 4) || '20' || substr(raw, 5, 2), '%m%d%Y')::DATE AS d FROM s), f AS ({_any(_ROW_CHECKS, 'r', 'k::INT AS row_number, ')})
        SELECT row_number, rule_id, severity FROM f"""),
    "isrc_format": (isrc_format, """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'us-pr1-26-' || lpad(p_partkey::VARCHAR, 5, '0') WHEN 1 THEN 'GBABC' || lpad(p_partkey::VARCHAR, 7, '0') ELSE 'INVALID-ISRC-007' END AS isrc FROM part)
        SELECT p_partkey, isrc, replace(upper(isrc), '-', '') AS isrc_key, regexp_full_match(upper(isrc), '[A-Z]{2}-[A-Z0-9]{3}-[0-9]{2}-[0-9]{5}|[A-Z]{2}[A-Z0-9]{3}[0-9]{7}') AS valid FROM p"""),
    "duration_parse": (duration_parse, "SELECT o_orderkey, ((o_orderkey % 60) * 60 + o_orderkey % 59) * 1000 AS iso_ms, ((o_orderkey % 100) * 60 + o_orderkey % 60) * 1000 AS mmss_ms FROM orders"),
    "artist_similarity": (artist_similarity, """WITH c AS (SELECT c_custkey AS id, lower(regexp_replace(c_name, '#0*', ' ')) AS artist FROM customer), k AS (SELECT 'customer ' || (s_suppkey * 37) AS name, s_suppkey AS pos FROM supplier),
        m AS (SELECT id, artist, name, levenshtein(artist, name)::INT AS distance, pos FROM c JOIN k ON levenshtein(artist, name) <= 1 QUALIFY row_number() OVER (PARTITION BY id, artist ORDER BY pos) = 1) SELECT id, artist, name, distance FROM m WHERE distance > 0"""),
    "keyword_spam": (keyword_spam, "SELECT conv_id, turn, array_to_string(list_filter(['and', 'ing', 'relax', 'the', 'zen'], lambda w: contains(lower(text), w)), '|') AS found FROM conversations"),
    "generic_titles": (generic_titles, """SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_id % 4 < 2) AS generic, round(count(*) FILTER (WHERE event_id % 4 < 2)::DOUBLE / count(*), 4) AS share FROM events GROUP BY 1"""),
    "formulaic_titles": (formulaic_titles, """WITH t AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 > 0 THEN 'sleep music' ELSE lower(l_returnflag) END AS p FROM lineitem), g AS (SELECT l_orderkey, p, count(*) AS n FROM t GROUP BY ALL)
        SELECT l_orderkey, coalesce(sum(n) FILTER (WHERE n >= 2), 0)::BIGINT AS formulaic FROM g GROUP BY 1"""),
    "uniform_duration": (uniform_duration, "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 0) >= 3 AND max(l_quantity * 1000) - min(l_quantity * 1000) <= 2000 AS uniform FROM lineitem GROUP BY 1"),
    "homoglyph_fold": (homoglyph_fold, "SELECT c_custkey, c_name AS folded, true AS odd FROM customer"),
    "normalize_artist": (normalize_artist, """SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') || CASE p_partkey % 3 WHEN 0 THEN ' and co' WHEN 1 THEN ' and crew' ELSE '' END AS normalized FROM part"""),
    "isrc_conflicts": (isrc_conflicts, """WITH l AS (SELECT DISTINCT l_orderkey AS release_id, 'USPR126' || lpad((l_partkey * 7 % 99999)::VARCHAR, 5, '0') AS isrc FROM lineitem)
        SELECT a.release_id, a.isrc, min(b.release_id) AS other_id FROM l a JOIN l b ON a.isrc = b.isrc AND a.release_id <> b.release_id GROUP BY ALL"""),
    "release_velocity_30d": (release_velocity, f"""WITH {T.SCANS} SELECT scan_id AS release_id, count(*) OVER (PARTITION BY release_id ORDER BY created_at RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS n_recent FROM scans"""),
    "fraud_signals": (fraud_signals, """WITH g AS (SELECT l_orderkey AS r, count(*) AS n, count(*) FILTER (WHERE l_quantity > 0) >= 3 AND max(l_quantity) FILTER (WHERE l_quantity > 0) * 10000 - min(l_quantity) FILTER (WHERE l_quantity > 0) * 10000 <= 2000 AS uniform, bool_or(l_quantity > 0 AND l_quantity < 6) AS short,
        CASE WHEN l_orderkey % 4 = 0 AND count(*) >= 2 THEN count(*) ELSE 0 END AS numbered FROM lineitem GROUP BY 1),
        m AS (SELECT *, (r % 2 = 0)::INT + (r % 5 = 0)::INT + (n > 20)::INT + coalesce(uniform, false)::INT + (n >= 3 AND numbered >= greatest(3, n * 0.7))::INT AS spam,
        (r % 3 = 0)::INT + (r % 7 = 0)::INT + (n >= 3 AND numbered >= n * 0.8)::INT + (r % 3 = 0 AND n >= 5)::INT + (coalesce(uniform, false) AND n >= 5)::INT AS ai FROM g)
        SELECT r AS release_id, 'fraud.functional_music_spam' AS signal_id, CASE WHEN spam = 2 THEN 'low' WHEN spam = 3 THEN 'medium' ELSE 'high' END AS confidence FROM m WHERE spam >= 2
        UNION ALL SELECT r, 'fraud.ai_generation_suspected', CASE WHEN ai = 2 THEN 'low' WHEN ai = 3 THEN 'medium' ELSE 'high' END FROM m WHERE ai >= 2 UNION ALL SELECT r, 'fraud.short_track_duration', 'high' FROM m WHERE short"""),
    "rule_eval_pass_fail": (rule_eval, f"WITH {_REC} " + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS rule_id, CASE WHEN {v} THEN 'pass' ELSE 'fail' END AS status FROM r" for k, v in _RULES.items())),
    "rule_eval_skip": (rule_eval_skip, "SELECT p_partkey, rule_id, severity, 'manual review required' AS message FROM part CROSS JOIN (VALUES " + ", ".join(map(str, _BY_HAND)) + ") v(rule_id, severity)"),
    "audio_thresholds": (audio_thresholds, f"""WITH {_PLAT}, t AS (SELECT p_partkey, ['wav', 'mp3', 'aiff', 'wma'][(p_partkey % 4)::INT + 1] AS format, [44100, 48000, 22050][(p_partkey % 3)::INT + 1] AS sample_rate, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 8 END AS bit_depth,
        p_size / -20.0::DOUBLE AS true_peak, p_size / -2.0::DOUBLE AS loudness, p_size * 5 AS seconds FROM part), b AS (SELECT * FROM t CROSS JOIN plat), f AS ({_any(_AUDIO, 'b', 'p_partkey, platform, ')}) SELECT p_partkey, platform, platform || '.audio.' || rule_id AS rule_id, severity FROM f"""),
    "artwork_checks": (artwork_checks, f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'gif' WHEN p_partkey % 4 < 3 THEN 'jpeg' END AS format, p_size * 400000 AS bytes, p_size * 100 AS w, CASE WHEN p_partkey % 2 = 0 THEN p_size * 100 ELSE 3500 END AS h,
        CASE p_partkey % 5 WHEN 0 THEN 'CMYK' WHEN 1 THEN 'L' ELSE 'RGB' END AS mode, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 400)::DOUBLE END AS dpi FROM part), f AS ({_any(_ART, 'a', 'p_partkey, ')}) SELECT p_partkey, 'universal.artwork.' || rule_id AS rule_id, severity FROM f"""),
    "peak_dbfs": (peak_dbfs, "SELECT vec_id, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 2) AS peak FROM embeddings"),
    "rule_label": (rule_label, "SELECT s_suppkey, 'Supplier ' || split_part(s_name, '#', 2) AS label FROM supplier"),
    "sha_keys": (sha_keys, "SELECT doc_id, sha256(text) AS digest, substr(sha256('key' || doc_id), 1, 8) AS prefix FROM documents"),
}
