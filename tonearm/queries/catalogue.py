"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bulk as B
from ..operators import scoring as S
from ..plans import analytics as A
from . import tables as T


def conflicts(spark, d):
    return A.conflicts(T.index(spark, d))


def conflicts_page(spark, d):
    return A.page(A.conflicts(T.index(spark, d), 2), [F.desc("has_artist_conflict"), "ean"], 2, 20)


def page_count(spark, d):
    return A.pages(A.conflicts(T.index(spark, d)), 20)


def stats(spark, d):
    return A.stats(T.index(spark, d))


def _spelled(spark, d):
    low = F.when(F.col("scan_id") % 2 == 0, F.upper("artist")).otherwise(F.col("artist"))
    return T.index(spark, d).withColumn("artist", low)


def variants(spark, d):
    return A.variants(_spelled(spark, d))


def artist_variants(spark, d):
    return B.artist_variants(_spelled(spark, d), ["org_id"])


def coverage(spark, d):
    return S.coverage(T.index(spark, d), ["org_id"])


def weekly_submissions(spark, d):
    s = T.scans(spark, d)
    return s.groupBy(F.extract(F.lit("YEAROFWEEK"), "created_at").cast("int").alias("iso_year"), F.extract(F.lit("WEEK"), "created_at").cast("int").alias("iso_week"), F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week_start")).agg(F.count("*").alias("scan_count"))


def submission_calendar(spark, d):
    s = T.scans(spark, d).groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week_start")).agg(F.count("*").alias("scan_count"), F.count_if(F.col("grade") == "FAIL").alias("failed"))
    return A.weekly(s, "1996-01-01", 12).withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


def _bulk(spark, d):
    """Parts as rows of a registration file."""
    p = T.load(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("int").alias("row_number"), F.lpad((F.col("p_partkey") % 900).cast("string"), 13, "0").alias("ean"),
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("artist"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("title"),
        F.when(F.col("p_size") % 4 > 0, F.lpad((F.col("p_size") % 7).cast("string"), 16, "1")).alias("isni"),
    )


_BULK = """b AS (SELECT p_partkey::INT AS row_number, lpad((p_partkey % 900)::VARCHAR, 13, '0') AS ean, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS artist,
 CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_type END AS title, CASE WHEN p_size % 4 > 0 THEN lpad((p_size % 7)::VARCHAR, 16, '1') END AS isni FROM part)"""


def group_consistency(spark, d):
    return B.check_groups(_bulk(spark, d)).select("key", "rule_id", "severity", "n_rows", "first_row")


def duplicate_keys(spark, d):
    r = T.load(spark, d, "part").select(F.col("p_partkey").cast("int").alias("row_number"), F.concat(F.lit("us-pr1-26-"), F.lpad((F.col("p_partkey") % 1500).cast("string"), 5, "0")).alias("isrc"))
    return B.duplicate_isrcs(r)


def clean_releases(spark, d):
    b = _bulk(spark, d)
    own = b.where("isni is null").select("row_number")
    shared = B.check_groups(b).where("rule_id = 'BULK_TITLE_INCONSISTENT'")
    return B.clean_rows(b, own, shared).select("row_number", "ean")


def affected_rows(spark, d):
    b = _bulk(spark, d)
    own = b.where("isni is null").select("row_number", F.lit("info").alias("severity"))
    return S.affected_rows(own, B.check_groups(b), B.group_rows(b))


def cross_catalogue(spark, d):
    h = T.index(spark, d)
    now = h.select("org_id", "ean", "artist", "title", "isni", "scan_id")
    now = now.groupBy("org_id", "ean").agg(F.min_by(F.struct("artist", "title", "isni"), "scan_id").alias("r")).select("org_id", "ean", "r.*")
    past = h.select("org_id", "ean", "artist", "title", "isni", F.col("scan_id").alias("first_seen"), F.col("scan_id").cast("string").alias("scan_id"), F.lit(False).alias("is_demo"))
    return B.catalogue_conflicts(now, past).select("org_id", "ean", "rule_id", "severity", "first_seen", "theirs")


def substring_mismatch(spark, d):
    mine = T.load(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" and "), (F.col("c_custkey") % 50).cast("string")).alias("artist"))
    theirs = T.load(spark, d, "customer").select(F.col("c_mktsegment").alias("artist"), F.col("c_custkey").cast("int").alias("row_number"))
    return B.artist_mismatches(mine, theirs)


_I = T.INDEX
_SPELLED = f"{_I}, s AS (SELECT * REPLACE (CASE WHEN scan_id % 2 = 0 THEN upper(artist) ELSE artist END AS artist) FROM idx)"
_AGG = "count(*) AS occurrences, count(DISTINCT artist_normalized) AS a, count(DISTINCT title_normalized) AS t, count(DISTINCT nullif(isni, '')) AS i, string_agg(DISTINCT artist, '|' ORDER BY artist) AS artists, string_agg(DISTINCT title, '|' ORDER BY title) AS titles"
_CONFLICT = "SELECT ean, occurrences, a > 1 AS has_artist_conflict, t > 1 AS has_title_conflict, i > 1 AS has_isni_conflict, artists, titles FROM g WHERE a > 1 OR t > 1 OR i > 1"
_GROUPS = """e AS (SELECT ean AS key, count(*) AS n_rows, min(row_number) AS first_row, count(DISTINCT lower(trim(artist))) AS a, count(DISTINCT lower(trim(title))) AS t, count(DISTINCT title) AS sp FROM b GROUP BY 1 HAVING count(*) > 1),
 ar AS (SELECT lower(trim(artist)) AS key, count(*) AS n_rows, min(row_number) AS first_row, count(isni) AS w, count(DISTINCT isni) AS i FROM b GROUP BY 1 HAVING count(*) > 1)"""
QUERIES = {
    "catalog_conflicts": (conflicts, f"WITH {_I}, g AS (SELECT ean, {_AGG} FROM idx GROUP BY 1) {_CONFLICT}"),
    "catalog_conflicts_page": (conflicts_page, f"WITH {_I}, g AS (SELECT ean, {_AGG} FROM idx WHERE org_id = 2 GROUP BY 1) {_CONFLICT} ORDER BY has_artist_conflict DESC, ean LIMIT 20 OFFSET 20"),
    "page_count": (page_count, f"WITH {_I}, g AS (SELECT ean, {_AGG} FROM idx GROUP BY 1), c AS ({_CONFLICT}) SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages FROM c"),
    "catalog_stats": (stats, f"""WITH {_I}, g AS (SELECT ean, count(*) AS n, count(nullif(isni, '')) AS w, count(DISTINCT artist_normalized) AS a, count(DISTINCT title_normalized) AS t, count(DISTINCT nullif(isni, '')) AS i FROM idx GROUP BY 1)
        SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_eans, sum(w)::BIGINT AS rows_with_isni, count(*) FILTER (WHERE a > 1 OR t > 1 OR i > 1) AS conflict_eans FROM g"""),
    "artist_variants": (variants, f"""WITH {_SPELLED}, g AS (SELECT artist_normalized, count(DISTINCT artist) AS n_variants, string_agg(DISTINCT artist, '|' ORDER BY artist) AS spellings, count(*) AS n_rows, count(nullif(isni, '')) AS w, count(DISTINCT nullif(isni, '')) AS i FROM s GROUP BY 1)
        SELECT artist_normalized, n_variants, spellings, n_rows, CASE WHEN i > 1 THEN 'conflicting' WHEN w = 0 THEN 'missing' WHEN w < n_rows THEN 'partial' ELSE 'consistent' END AS isni_status FROM g WHERE n_variants > 1"""),
    "artist_variants_by_org": (artist_variants, f"""WITH {_SPELLED} SELECT org_id, lower(artist) AS artist_normalized, count(DISTINCT artist) AS n_variants, string_agg(DISTINCT artist, '|' ORDER BY artist) AS variants, count(*) AS n_rows FROM s GROUP BY 1, 2 HAVING count(DISTINCT artist) > 1"""),
    "identifier_coverage": (coverage, f"""WITH {_I}, x AS (SELECT org_id, coalesce(isni, '') <> '' AS a, coalesce(iswc, '') <> '' AS b FROM idx), g AS (SELECT org_id, count(*) AS total, count(*) FILTER (WHERE a) AS with_isni, count(*) FILTER (WHERE b) AS with_iswc, count(*) FILTER (WHERE a AND b) AS with_both, count(*) FILTER (WHERE NOT a AND NOT b) AS with_neither FROM x GROUP BY 1)
        SELECT *, round(with_isni * 100.0::DOUBLE / total, 1)::DOUBLE AS isni_pct, round(with_iswc * 100.0::DOUBLE / total, 1)::DOUBLE AS iswc_pct FROM g"""),
    "weekly_submissions": (weekly_submissions, f"""WITH {T.SCANS} SELECT isoyear(created_at)::INT AS iso_year, week(created_at)::INT AS iso_week, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week_start, count(*) AS scan_count FROM scans GROUP BY ALL"""),
    "submission_calendar": (submission_calendar, f"""WITH {T.SCANS}, s AS (SELECT date_trunc('week', created_at)::DATE AS w, count(*) AS scan_count, count(*) FILTER (WHERE grade = 'FAIL') AS failed FROM scans GROUP BY 1),
        spine AS (SELECT (DATE '1996-01-01' + (7 * i)::INT) AS w FROM range(12) t(i)) SELECT strftime(w, '%Y-%m-%d') AS week_start, coalesce(scan_count, 0) AS scan_count, coalesce(failed, 0) AS failed FROM spine LEFT JOIN s USING (w)"""),
    "group_consistency": (group_consistency, f"""WITH {_BULK}, {_GROUPS}
        SELECT key, 'BULK_EAN_DUPLICATE' AS rule_id, 'critical' AS severity, n_rows, first_row FROM e UNION ALL SELECT key, 'BULK_ARTIST_INCONSISTENT', 'warning', n_rows, first_row FROM e WHERE a > 1
        UNION ALL SELECT key, 'BULK_TITLE_INCONSISTENT', 'warning', n_rows, first_row FROM e WHERE t > 1 OR sp > 1 UNION ALL SELECT key, 'BULK_ISNI_INCONSISTENT', 'warning', n_rows, first_row FROM ar WHERE w > 0 AND w < n_rows
        UNION ALL SELECT key, 'BULK_ISNI_CONFLICTING', 'critical', n_rows, first_row FROM ar WHERE w = n_rows AND i > 1"""),
    "duplicate_keys": (duplicate_keys, """WITH r AS (SELECT p_partkey::INT AS row_number, 'USPR126' || lpad((p_partkey % 1500)::VARCHAR, 5, '0') AS isrc_key FROM part)
        SELECT * FROM (SELECT isrc_key, count(*) OVER (PARTITION BY isrc_key) AS n, row_number FROM r) WHERE n > 1"""),
    "clean_releases": (clean_releases, f"""WITH {_BULK}, {_GROUPS} SELECT row_number, ean FROM b WHERE isni IS NOT NULL AND ean NOT IN (SELECT key FROM e WHERE t > 1 OR sp > 1)"""),
    "affected_rows": (affected_rows, f"""WITH {_BULK}, {_GROUPS} SELECT DISTINCT row_number FROM b WHERE ean IN (SELECT key FROM e) OR lower(trim(artist)) IN (SELECT key FROM ar WHERE (w > 0 AND w < n_rows) OR (w = n_rows AND i > 1))"""),
    "cross_catalog_first_conflict": (cross_catalogue, f"""WITH {_I}, n AS (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY org_id, ean ORDER BY scan_id) = 1),
        j AS (SELECT h.org_id, h.ean, h.scan_id AS first_seen, lower(h.artist) AS ha, lower(n.artist) AS na, lower(h.title) AS ht, lower(n.title) AS nt, nullif(h.isni, '') AS hi, nullif(n.isni, '') AS ni FROM idx h JOIN n USING (org_id, ean)),
        k AS (SELECT org_id, ean, first_seen, 'CROSS_CATALOG_EAN_CONFLICT' AS rule_id, 'critical' AS severity, ha AS theirs FROM j WHERE ha <> na UNION ALL SELECT org_id, ean, first_seen, 'CROSS_CATALOG_TITLE_CONFLICT', 'warning', ht FROM j WHERE ht <> nt
         UNION ALL SELECT org_id, ean, first_seen, 'CROSS_CATALOG_ISNI_CONFLICT', 'critical', hi FROM j WHERE hi <> ni)
        SELECT org_id, ean, rule_id, severity, first_seen, theirs FROM k QUALIFY row_number() OVER (PARTITION BY org_id, ean, rule_id ORDER BY first_seen) = 1"""),
    "substring_mismatch": (substring_mismatch, """WITH m AS (SELECT DISTINCT lower(c_mktsegment) || ' and ' || (c_custkey % 50) AS artist FROM customer), t AS (SELECT lower(c_mktsegment) AS other, min(c_custkey) AS r FROM customer GROUP BY 1),
        x AS (SELECT artist, other, r FROM m JOIN t ON contains(artist, other) OR contains(other, artist) WHERE artist NOT IN (SELECT other FROM t)) SELECT artist, arg_min(other, r) AS other FROM x GROUP BY 1"""),
}
