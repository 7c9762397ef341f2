"""A scan from its layers to its score: each layer's findings in one form, what several layers tell counted once, one aggregation for the scores.

Layers are DataFrames, made by the functions here or by others in the same form: the key, rule_id, severity, status (fail, warn),
message, actual and targets (platforms; empty: all). Only layers that were asked for and that the tier allows run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators import fraud as D
from ..operators import media as M
from ..operators import scoring as S
from ..schema import RELEASE_DEFAULTS, with_release_defaults
from . import rules as R

LAYERS = ("ddex", "metadata", "fraud", "audio", "artwork", "enrichment")
FORM = {"rule_id": "string", "severity": "string", "status": "string", "message": "string", "actual": "string", "targets": "array<string>"}


def context(releases: DataFrame) -> DataFrame:
    """The record that rules judge, from what a source gave: known fields as they are, codes and composers of its tracks, defaults for the rest. Other columns stay."""
    made = {}
    if "tracks" in releases.columns:
        known = {f.name for f in releases.schema["tracks"].dataType.elementType.fields}
        listed = lambda name: F.array_distinct(F.array_remove(F.array_compact(F.transform(F.coalesce("tracks", F.array().cast(releases.schema["tracks"].dataType)), lambda t: F.trim(t[name]))), ""))
        if "isrc" in known and "isrc_list" not in releases.columns:
            made["isrc_list"] = listed("isrc")
        if "composer" in known and "composers" not in releases.columns:
            made["composers"] = listed("composer")
    if "territory" not in releases.columns:
        made["territory"] = F.lit("Worldwide")
    if "p_line" in releases.columns and "p_line_year" not in releases.columns:
        made["p_line_year"] = F.regexp_extract(F.coalesce("p_line", F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1)
    if "release_date" in releases.columns:
        made["release_date"] = F.coalesce(F.col("release_date").cast("string"), F.lit(""))
    return with_release_defaults(releases.withColumns(made) if made else releases)


def status_of(severity: Column) -> Column:
    return F.when(severity == "critical", "fail").otherwise("warn")


def in_form(findings: DataFrame, key: str) -> DataFrame:
    """Findings with all columns of the form, absent ones filled in."""
    have = set(findings.columns)
    fill = {"status": status_of(F.col("severity")), "targets": F.array().cast("array<string>")}
    return findings.select(key, *[(F.col(n) if n in have else fill.get(n, F.lit(None))).cast(t).alias(n) for n, t in FORM.items()])


def metadata_layer(records: DataFrame, key: str, rules: list[R.Rule], platforms=R.DEFAULT_PLATFORMS) -> DataFrame:
    """Rules that fail; records: of context()."""
    missing = [f for f in RELEASE_DEFAULTS if f not in records.columns]
    judged = R.evaluate(with_release_defaults(records) if missing else records, rules, [key], platforms)
    return in_form(judged.where("status = 'fail'").select(key, "rule_id", "severity", "message", F.col("checked_value").alias("actual"), F.array(*map(F.lit, platforms)).alias("targets")), key)


def fraud_layer(signals: DataFrame, key: str, definitions: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Signals with their definitions; advisory ones warn. exempt: keys of test organisations' releases, which have no velocity signals."""
    if exempt is not None:
        fast = F.contains("signal_id", F.lit("high_release_velocity"))
        signals = signals.where(~fast).unionByName(signals.where(fast).join(exempt.select(key).distinct(), key, "left_anti").select(*signals.columns))
    known = D.with_definitions(signals, definitions)
    rule = F.when(F.startswith("signal_id", F.lit("fraud.")), F.col("signal_id")).otherwise(F.concat(F.lit("fraud."), "signal_id"))
    return in_form(known.select(key, rule.alias("rule_id"), "severity", F.when(F.col("advisory"), "warn").otherwise("fail").alias("status"), F.col("explanation").alias("message")), key)


def audio_layer(releases: DataFrame, tracks: DataFrame, key: str, platforms: DataFrame) -> DataFrame:
    """Findings by platform, findings of the track alone where it is measured, and one for each release without audio."""
    found = in_form(M.audio_findings(tracks, platforms, [key]).withColumn("targets", F.array("platform")), key)
    if {"true_peak", "leading_silence", "trailing_silence"} <= set(tracks.columns):
        found = found.unionByName(in_form(M.measured_findings(tracks, [key]), key))
    return found.unionByName(in_form(M.missing(releases, tracks, key, "universal.audio.not_provided", "no audio was given"), key))


def artwork_layer(releases: DataFrame, art: DataFrame, key: str) -> DataFrame:
    return in_form(M.artwork_findings(art, [key]), key).unionByName(in_form(M.missing(releases, art, key, "universal.artwork.not_provided", "no artwork was given"), key))


def results(layers: dict[str, DataFrame], key: str, asked=LAYERS, allowed=LAYERS) -> DataFrame:
    """All findings of the layers that run, with `layer` and `duplicate`. The layers are read once each."""
    running = {name: in_form(layers[name], key) for name in LAYERS if name in layers and name in asked and name in allowed}
    if not running:
        raise ValueError("no layer is left to run")
    return O.cross_layer_dedup(O.union_findings(**running), key)


def scores(releases: DataFrame, found: DataFrame, key: str, critical_first: bool = False) -> DataFrame:
    """Counts, score and grade of every release, those without findings too; duplicates don't count."""
    counted = S.readiness(found.where("not duplicate"), [key], error_as="critical" if critical_first else "info")
    out = releases.select(key).distinct().join(counted, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole = [zero(c) for c in ("critical_count", "warning_count", "info_count")]
    return out.select(key, *whole, (F.coalesce("critical_count", F.lit(0)) + F.coalesce("warning_count", F.lit(0)) + F.coalesce("info_count", F.lit(0))).alias("total_issues"), F.coalesce("score", F.lit(100.0)).alias("score"), F.coalesce("grade", F.lit("PASS")).alias("grade"))
