"""Readiness scores and grades: one aggregation with map-side sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GRADES


def penalty(critical: Column, warning: Column, info: Column | None) -> Column:
    """100 less 10 a critical (60 at most), 3 a warning (25 at most), half a point an info (5 at most)."""
    score = F.lit(100.0) - F.least(critical * 10.0, F.lit(60.0)) - F.least(warning * 3.0, F.lit(25.0))
    if info is not None:
        score = score - F.least(info * 0.5, F.lit(5.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1)


def grade(score: Column) -> Column:
    out = F.lit("FAIL")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def readiness(findings: DataFrame, keys: list[str], with_info: bool = True, error_as: str = "info") -> DataFrame:
    """Counts, score and grade by keys. Resolved findings, passes and the enrichment layer don't count.

    error_as tells which counter an `error` goes to: info, or critical.
    """
    names = findings.columns
    live = F.lit(True)
    if "resolved" in names:
        live = live & ~F.coalesce("resolved", F.lit(False))
    if "status" in names:
        live = live & (F.coalesce("status", F.lit("")) != "pass")
    if "layer" in names:
        live = live & (F.coalesce("layer", F.lit("")) != "enrichment")
    s = F.col("severity")
    sums = findings.groupBy(*keys).agg(
        F.count_if(live & ((s == "critical") | ((s == "error") & F.lit(error_as == "critical")))).alias("critical_count"),
        F.count_if(live & (s == "warning")).alias("warning_count"),
        F.count_if(live & ((s == "info") | ((s == "error") & F.lit(error_as == "info")))).alias("info_count"),
    )
    score = penalty(F.col("critical_count"), F.col("warning_count"), F.col("info_count") if with_info else None)
    return sums.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def layer_scores(findings: DataFrame, key: str, layers: list[str], layer: str = "layer") -> DataFrame:
    """A score for each key and layer; layers without findings have 100."""
    found = readiness(findings.withColumnRenamed(layer, "__layer"), [key, "__layer"])
    spine = findings.select(key).distinct().withColumn("__layer", F.explode(F.array(*[F.lit(x) for x in layers])))
    return spine.join(found.select(key, "__layer", "score"), [key, "__layer"], "left").select(key, F.col("__layer").alias(layer), F.coalesce("score", F.lit(100.0)).alias("score"))


def platform_readiness(findings: DataFrame, key: str, platforms: list[str], targets: str = "targets") -> DataFrame:
    """Ready or not for each platform: no unresolved critical targets it; a critical without targets concerns all."""
    critical = (F.col("severity") == "critical") & ~F.coalesce("resolved", F.lit(False))
    everywhere = F.coalesce(F.size(targets), F.lit(0)) <= 0
    flags = [F.max(critical & (everywhere | F.coalesce(F.array_contains(targets, p), F.lit(False)))).alias(p) for p in platforms]
    wide = findings.groupBy(key).agg(*flags)
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), (~F.coalesce(F.col(p), F.lit(False))).alias("ready")) for p in platforms])).alias("r")).select(key, "r.*")


def coverage(df: DataFrame, keys: list[str], isni: str = "isni", iswc: str = "iswc") -> DataFrame:
    """How many rows have either identifier, both or none, and the shares in percent."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    a, b = has(isni), has(iswc)
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(a).alias("with_isni"), F.count_if(b).alias("with_iswc"), F.count_if(a & b).alias("with_both"), F.count_if(~a & ~b).alias("with_neither")
    )
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("total")), F.lit(0.0)), 1)
    return counts.withColumns({"isni_pct": share("with_isni"), "iswc_pct": share("with_iswc")})


def issues_by_row(issues: DataFrame, releases: DataFrame, row: str = "row_number") -> DataFrame:
    """A row for each release row with issues: its fields and its issues, critical ones first."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    by_row = issues.where(F.col(row).isNotNull()).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "rule_id", "severity", "message"))).alias("issues"))
    fields = [c for c in ("ean", "artist", "title", "isni", "iswc") if c in releases.columns]
    out = by_row.join(releases.select(row, *fields).dropDuplicates([row]), row, "left")
    return out.select(row, *fields, F.transform("issues", lambda i: F.struct(i["severity"].alias("severity"), i["rule_id"].alias("rule_id"), i["message"].alias("message"))).alias("issues"))


# Labels of the validated fields, in their order.
FIELD_LABELS = {
    "title": "Release Title", "artist": "Artist", "label": "Label", "release_type": "Release Type", "genre": "Genre", "release_date": "Release Date", "upc": "UPC / Barcode",
    "p_line": "P-Line", "c_line": "C-Line", "parental_warning": "Parental Warning", "territory": "Territory", "publisher": "Publisher",
}


def validated_fields(releases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and fields: an array of label, value and format of what isn't empty. tracks: array of structs with title and isrc."""
    c, text = F.col, lambda label, value: F.when(value.cast("string") != "", F.struct(F.lit(label).alias("label"), F.array(value.cast("string")).alias("value"), F.lit("text").alias("format")))
    lines = F.transform("tracks", lambda t, i: F.concat_ws(" \u2014 ", F.concat(F.lit("Track "), (i + 1).cast("string")), F.nullif(t["title"], F.lit("")), F.nullif(t["isrc"], F.lit(""))))
    isrcs = F.array_join(F.filter(F.transform("tracks", lambda t: t["isrc"]), lambda x: x != ""), ", ")
    made = [text(label, c(name)) for name, label in FIELD_LABELS.items() if name in releases.columns]
    if "tracks" in releases.columns:
        some = F.size("tracks") > 0
        made += [F.when(some, text("Track Count", F.size("tracks"))), text("ISRCs", isrcs), F.when(some, F.struct(F.lit("Tracks").alias("label"), lines.alias("value"), F.lit("list").alias("format")))]
    if {"artwork_width", "artwork_height"} <= set(releases.columns):
        made.append(F.when((c("artwork_width") > 0) & (c("artwork_height") > 0), text("Artwork", F.concat(c("artwork_width").cast("string"), F.lit("\u00d7"), c("artwork_height").cast("string"), F.lit(" px")))))
    return releases.select(*keys, F.array_compact(F.array(*made)).alias("fields"))


def affected_rows(row_issues: DataFrame, group_issues: DataFrame, members: DataFrame, row: str = "row_number") -> DataFrame:
    """Distinct rows with a critical or warning issue, own or shared. members: kind, key and row, as of bulk.group_rows()."""
    grave = F.col("severity").isin("critical", "warning")
    shared = members.join(group_issues.where(grave).select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    return row_issues.where(grave).select(row).where(F.col(row).isNotNull()).unionByName(shared.select(row)).distinct()
