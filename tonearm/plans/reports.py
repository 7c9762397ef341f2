"""What reports and pages show of findings: shares by layer, counts by rule group, groups by severity, rows with their enrichment, one document a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import layout as L
from ..functions import identifiers as I
from ..operators import scoring as S
from ..schema import severity_rank

#: Tracks of a task where they meet their releases.
TRACKS = 500_000

# Rule groups of the two kinds of registration files.
RULE_GROUPS = {
    "bulk_registration": {
        "EAN Validation": ("BULK_EAN_FORMAT", "BULK_EAN_DUPLICATE", "CROSS_CATALOG_EAN_CONFLICT"),
        "Release Data": ("BULK_DATE_FORMAT", "BULK_DATE_FUTURE", "BULK_ARTIST_MISSING", "BULK_TITLE_MISSING", "BULK_IMPRINT_MISSING", "BULK_NARM_UNKNOWN", "BULK_LABEL_ABBR_INVALID", "BULK_COUNTRY_CODE_INVALID", "BULK_COUNTRY_CODE_MISSING", "BULK_ARTIST_INCONSISTENT", "BULK_TITLE_INCONSISTENT"),
        "Cross-Catalog": ("CROSS_CATALOG_EAN_CONFLICT", "CROSS_CATALOG_TITLE_CONFLICT", "CROSS_CATALOG_ISNI_CONFLICT", "CROSS_CATALOG_ARTIST_VARIANT", "ISRC_ARTIST_INCONSISTENT"),
        "Identifier Coverage": ("BULK_ISNI_FORMAT", "BULK_ISNI_MISSING", "BULK_ISWC_FORMAT", "BULK_ISWC_MISSING", "BULK_ISNI_INCONSISTENT", "BULK_ISNI_CONFLICTING"),
    },
    "isrc_registration": {
        "ISRC Validation": ("ISRC_FORMAT", "ISRC_DUPLICATE", "ISRC_MISSING_HYPHENS"),
        "Release Data": ("ISRC_ARTIST_MISSING", "ISRC_TITLE_MISSING", "ISRC_DATE_FORMAT", "ISRC_LABEL_ABBR_INVALID", "ISRC_COUNTRY_CODE_INVALID", "ISRC_COUNTRY_CODE_MISSING"),
    },
}


def whole_percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, halves up; null of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + F.lit(0.5)).cast("long"))


def pass_share(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Releases and the share whose latest scan passed. latest: keys and grade, a row a release."""
    g = latest.groupBy(*keys).agg(F.count("*").alias("releases"), F.count_if(F.col("grade") == "PASS").alias("passed"))
    return g.select(*keys, "releases", whole_percent(F.col("passed"), F.col("releases")).alias("pass_rate"))


def layer_shares(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences by layer and their share of all of the keys. issues: keys, layer, occurrences."""
    by_layer = issues.groupBy(*keys, "layer").agg(F.sum("occurrences").alias("occurrences"))
    whole = F.sum("occurrences").over(Window.partitionBy(*keys)) if keys else F.sum("occurrences").over(Window.partitionBy(F.lit(0)))  # a row a layer
    return by_layer.select(*keys, "layer", "occurrences", F.coalesce(whole_percent(F.col("occurrences"), whole), F.lit(0).cast("long")).alias("share"))


def _graves(live: Column) -> list[Column]:
    s = F.col("severity")
    return [F.count_if(live & s.isin("critical", "error")).alias("critical_count"), F.count_if(live & (s == "warning")).alias("warning_count")]


def layer_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Unresolved criticals (errors with them) and warnings by keys and layer."""
    return results.groupBy(*keys, "layer").agg(*_graves(~F.coalesce("resolved", F.lit(False))))


def group_counts(results: DataFrame, keys: list[str], layer: str = "bulk_registration") -> DataFrame:
    """The same by keys and rule group of a registration layer; a rule may be of several groups, a group without findings has zeros."""
    groups = RULE_GROUPS[layer]
    member = F.array_compact(F.array(*[F.when(F.col("rule_id").isin(*rules), F.lit(name)) for name, rules in groups.items()]))
    rows = results.where(F.col("layer") == layer)
    found = rows.select(*keys, F.explode(member).alias("rule_group"), "severity", "resolved").groupBy(*keys, "rule_group").agg(*_graves(~F.coalesce("resolved", F.lit(False))))
    spine = rows.select(*keys).distinct().withColumn("rule_group", F.explode(F.array(*map(F.lit, groups))))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("critical_count", "warning_count")]
    return spine.join(found, [*keys, "rule_group"], "left").select(*keys, "rule_group", *zero)


def issue_groups(results: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Findings with their place in the report of their keys: critical, error, warning, info, then unknown ones; none is dropped."""
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), *tie)
    return results.withColumn("place", F.row_number().over(order))


def report_rows(issues: DataFrame, releases: DataFrame, enrichment: DataFrame, row: str = "row_number") -> DataFrame:
    """issues_by_row with what enrichment suggests for the row; rows without either have nulls."""
    out = S.issues_by_row(issues, releases, row)
    some = [c for c in ("suggested_isni", "suggested_iswc", "isni_match_quality", "iswc_match_quality") if c in enrichment.columns]
    return out.join(enrichment.select(row, F.struct(*some).alias("enrichment")).dropDuplicates([row]), row, "left")


def org_isrcs(tracks: DataFrame, releases: DataFrame, org_id=None) -> DataFrame:
    """ISRCs of an organisation's releases, or of every one's by organisation: the key form, the first release and how many hold it. Blank ones are left out."""
    own = releases if org_id is None else releases.where(F.col("org_id") == org_id)
    codes = tracks.where(~I.blank(F.col("isrc"))).select("release_id", I.isrc_key(F.col("isrc")).alias("isrc"))
    n = L.parts(tracks.count(), TRACKS)
    # a release's tracks are together once they have met it, so its codes become distinct there, and only counts of codes go on
    held = codes.repartition(n, "release_id").join(own.select("release_id", "org_id").repartition(n, "release_id"), "release_id")
    once = held.select("release_id", "org_id", "isrc").distinct()
    return once.groupBy("org_id", "isrc").agg(F.min("release_id").alias("release_id"), F.count("release_id").alias("releases"))


def newest(rows: DataFrame, at: str, tie: str, k: int = 50) -> DataFrame:
    """The k newest rows, the newest first; rows without a time come last."""
    return rows.orderBy(F.desc_nulls_last(at), F.desc(tie)).limit(k)


def scan_report(scans: DataFrame, results: DataFrame, key: str, layers: list[str]) -> DataFrame:
    """One row a scan for a report: its counts and grade, a score a layer, and its open issues, worst first. Enrichment is told apart and doesn't count."""
    open_ones = results.where(~F.coalesce("resolved", F.lit(False)))
    counted = S.readiness(results, [key])
    by_layer = S.layer_scores(results, key, layers).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "score")))).alias("layer_scores"))
    rank = severity_rank(F.col("severity"))
    issue = F.struct(rank.alias("rank"), "layer", "rule_id", "severity")
    issues = open_ones.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(c, issue))).alias(n) for n, c in (("issues", F.col("layer") != "enrichment"), ("suggestions", F.col("layer") == "enrichment"))])
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<rank:int,layer:string,rule_id:string,severity:string>>")), lambda i: F.struct(i["severity"].alias("severity"), i["layer"].alias("layer"), i["rule_id"].alias("rule_id")))
    out = scans.join(counted, key, "left").join(by_layer, key, "left").join(issues, key, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("critical_count", "warning_count", "info_count")]
    return out.select(*scans.columns, *zero, F.coalesce("score", F.lit(100.0)).alias("score"), "layer_scores", plain("issues").alias("issues"), plain("suggestions").alias("suggestions"))


