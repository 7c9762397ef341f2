"""Catalogue, overview, dashboard and usage queries. Tables are DataFrames; org_id scopes each to a tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_org(df: DataFrame, org_id=None) -> DataFrame:
    return df if org_id is None else df.where(F.col("org_id") == org_id)


def given(name: str) -> Column:
    return F.when(F.col(name).isNotNull() & (F.col(name) != ""), F.col(name))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 1)


# ------------------------------------------------------------------ catalogue
def _by_ean(index: DataFrame, org_id=None) -> DataFrame:
    return of_org(index, org_id).groupBy("ean").agg(
        F.count("*").alias("occurrences"), F.count_distinct("artist_normalized").alias("n_artists"), F.count_distinct("title_normalized").alias("n_titles"), F.count_distinct(given("isni")).alias("n_isnis"),
        F.array_join(F.array_sort(F.collect_set("artist")), "|").alias("artists"), F.array_join(F.array_sort(F.collect_set("title")), "|").alias("titles"),
    )


def conflicts(index: DataFrame, org_id=None) -> DataFrame:
    """EANs with several artists, titles or ISNIs; order by has_artist_conflict DESC, ean to page."""
    g = _by_ean(index, org_id).where("n_artists > 1 or n_titles > 1 or n_isnis > 1")
    return g.select("ean", "occurrences", (F.col("n_artists") > 1).alias("has_artist_conflict"), (F.col("n_titles") > 1).alias("has_title_conflict"), (F.col("n_isnis") > 1).alias("has_isni_conflict"), "artists", "titles")


def stats(index: DataFrame, org_id=None) -> DataFrame:
    """One row: totals, identified shares and EANs in conflict."""
    by_ean = of_org(index, org_id).groupBy("ean").agg(F.count("*").alias("n"), F.count(given("isni")).alias("with_isni"), F.count_distinct("artist_normalized").alias("a"), F.count_distinct("title_normalized").alias("t"), F.count_distinct(given("isni")).alias("i"))
    return by_ean.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_eans"), F.coalesce(F.sum("with_isni"), F.lit(0)).alias("rows_with_isni"),
        F.count_if((F.col("a") > 1) | (F.col("t") > 1) | (F.col("i") > 1)).alias("conflict_eans"),
    )


def variants(index: DataFrame, org_id=None) -> DataFrame:
    """Artists with several spellings, and whether their ISNIs agree."""
    g = of_org(index, org_id).groupBy("artist_normalized").agg(
        F.count_distinct("artist").alias("n_variants"), F.array_join(F.array_sort(F.collect_set("artist")), "|").alias("spellings"), F.count("*").alias("n_rows"), F.count(given("isni")).alias("with_isni"), F.count_distinct(given("isni")).alias("n_isnis")
    )
    status = F.when(F.col("n_isnis") > 1, "conflicting").when(F.col("with_isni") == 0, "missing").when(F.col("with_isni") < F.col("n_rows"), "partial").otherwise("consistent")
    return g.where("n_variants > 1").select("artist_normalized", "n_variants", "spellings", "n_rows", status.alias("isni_status"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a result, from 1. Give a unique order."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size).cast("long")))


def weekly(submissions: DataFrame, first_week: str, weeks: int, keys: list[str] | None = None) -> DataFrame:
    """Counts by ISO week without gaps. submissions: week_start and counters."""
    spark = submissions.sparkSession
    spine = spark.range(weeks).select(F.date_add(F.lit(first_week).cast("date"), F.col("id").cast("int") * 7).alias("week_start"))
    counters = [c for c in submissions.columns if c not in ("week_start", *(keys or []))]
    sums = submissions.groupBy("week_start").agg(*[F.sum(c).alias(c) for c in counters])
    return spine.join(sums, "week_start", "left").select("week_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])


# ------------------------------------------------------------------ overview
def top_issues(results: DataFrame, scans: DataFrame, k: int = 10, org_id=None) -> DataFrame:
    """Most frequent unresolved findings, ties by rule."""
    joined = results.where(~F.coalesce("resolved", F.lit(False))).join(of_org(scans, org_id).select("scan_id"), "scan_id", "left_semi")
    return joined.groupBy("rule_id", "layer", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id", "layer", "severity").limit(k)


def pass_rate(scans: DataFrame, unit: str = "day", org_id=None) -> DataFrame:
    s = of_org(scans, org_id).groupBy(F.date_format(F.date_trunc(unit, "created_at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("total"), F.count_if(F.col("grade") == "PASS").alias("passed"))
    return s.withColumn("pass_rate", percent(F.col("passed"), F.col("total")))


def platform_breakdown(results: DataFrame, targets: str = "targets") -> DataFrame:
    e = results.select(F.explode(targets).alias("platform"), "severity")
    return e.groupBy("platform").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


def platform_matrix(results: DataFrame, scans: DataFrame) -> DataFrame:
    """Failure rate by platform and month, and its change from the month before (only if that has data)."""
    hit = results.where(F.col("severity") == "critical").select("scan_id", F.explode("targets").alias("platform")).distinct()
    month = scans.select("scan_id", F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM-dd").alias("month"))
    total = month.groupBy("month").agg(F.count("*").alias("scans"))
    failed = hit.join(month, "scan_id").groupBy("platform", "month").agg(F.count("*").alias("failed"))
    rate = failed.join(total, "month").withColumn("failure_rate", percent(F.col("failed"), F.col("scans")))
    w = Window.partitionBy("platform").orderBy("month")
    prev_month = F.date_format(F.add_months(F.to_date("month"), -1), "yyyy-MM-dd")
    return rate.withColumn("change", F.when(F.lag("month").over(w) == prev_month, F.round(F.col("failure_rate") - F.lag("failure_rate").over(w), 1)))


def top_per_group(results: DataFrame, group: str, item: str, k: int = 3) -> DataFrame:
    counts = results.groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ dashboards
def severity_trend(results: DataFrame, first_day: str, days: int) -> DataFrame:
    """Findings by day and severity without gaps."""
    spark = results.sparkSession
    spine = spark.range(days).select(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("d"))
    lo, hi = F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days)
    sums = results.where((F.col("created_at") >= lo) & (F.col("created_at") < hi)).groupBy(F.to_date("created_at").alias("d")).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    return spine.join(sums, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format("d", "M/d").alias("label"), *[F.coalesce(s, F.lit(0)).alias(s) for s in ("critical", "warning", "info")])


def latest_scan(releases: DataFrame, scans: DataFrame) -> DataFrame:
    """Releases with their latest scan, by one aggregation instead of a query for each."""
    last = scans.groupBy("release_id").agg(F.max_by(F.struct("scan_id", "grade", "created_at"), F.struct("created_at", "scan_id")).alias("s"))
    return releases.join(last, "release_id", "left").select(*releases.columns, "s.scan_id", "s.grade", F.date_format("s.created_at", "yyyy-MM-dd").alias("scanned"))


def org_rollup(orgs: DataFrame, releases: DataFrame, scans: DataFrame) -> DataFrame:
    """Releases and scans by organisation: children are aggregated first, so no join multiplies rows."""
    r = releases.groupBy("org_id").agg(F.count("*").alias("releases"))
    s = scans.join(releases.select("release_id", "org_id"), "release_id").groupBy("org_id").agg(F.count("*").alias("scans"))
    return orgs.join(r, "org_id", "left").join(s, "org_id", "left").select(*orgs.columns, F.coalesce("releases", F.lit(0)).alias("releases"), F.coalesce("scans", F.lit(0)).alias("scans"))


def batch_progress(items: DataFrame) -> DataFrame:
    """Jobs with their counters; complete when all ended, failed if any did."""
    g = items.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    ended = F.col("completed") + F.col("failed") >= F.col("total")
    return g.withColumn("job_status", F.when(ended & (F.col("failed") > 0), "failed").when(ended, "complete").otherwise("processing"))


def search(releases: DataFrame, text: str | None = None, columns: tuple = ("title", "artist"), status: str | None = None) -> DataFrame:
    """Case-insensitive substring search in any of the columns; % and _ are taken as they are."""
    out = releases
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
        out = out.where(hit)
    return out if status is None else out.where(F.col("status") == status)


# ------------------------------------------------------------------ usage
def usage_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("latency_ms"), 1).alias("avg_latency"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_call"))


def usage_history(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"))


# ------------------------------------------------------------------ tiers
# Tiers, the lowest first.
TIERS = ("starter", "pro", "enterprise")


def tier_allows(tier: Column, least: str) -> Column:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return rank >= TIERS.index(least) + 1


def quota_left(used: Column, limit: Column) -> Column:
    """Calls left; null where the limit is -1, unlimited."""
    return F.when(limit >= 0, F.greatest(limit - used, F.lit(0)))


def allowed_layers(requested: Column, allowed: Column) -> Column:
    return F.array_intersect(requested, allowed)
