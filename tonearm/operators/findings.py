"""Findings: from boolean columns to a long table, and operations on that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FINDING, severity_rank


def finding(condition: Column, rule_id: str, severity: str, message: Column | str, field: str = "", actual: Column | None = None) -> Column:
    """A finding where the condition holds, else null (unknown counts as not)."""
    message = F.lit(message) if isinstance(message, str) else message
    actual = F.lit(None) if actual is None else actual
    body = F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), message.cast("string").alias("message"),
        F.lit(field).alias("field"), actual.cast("string").alias("actual"),
    )
    return F.when(F.coalesce(condition, F.lit(False)), body).cast(FINDING)


def explode_findings(df: DataFrame, keys: list[str], found: list[Column]) -> DataFrame:
    """All findings of all rows in a single pass over the input: one projection, one explode."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "f.*")


def union_findings(**layers: DataFrame) -> DataFrame:
    """Findings of several layers, with the layer's name."""
    out = None
    for name, df in layers.items():
        df = df.withColumn("layer", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def cross_layer_dedup(findings: DataFrame, key: str) -> DataFrame:
    """Adds `duplicate`: whether a more specific layer already tells what a finding tells.

    Artwork findings outweigh metadata rules on artwork; a structural ISRC or publisher finding the metadata rule on it; a
    metadata finding that quotes a short track outweighs the short-track signal that names it.
    """
    w = Window.partitionBy(key)
    msg, rule, layer = F.lower(F.coalesce("message", F.lit(""))), F.lower(F.coalesce("rule_id", F.lit(""))), F.col("layer")
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False))).over(w)
    quoted = F.when((layer == "metadata") & F.contains("message", F.lit(" seconds")), F.nullif(F.lower(F.regexp_extract("message", '^"([^"]*)"', 1)), F.lit("")))
    marked = findings.withColumns(
        {
            "__artwork": any_of(layer == "artwork"),
            "__isrc": any_of((layer == "ddex") & F.contains(msg, F.lit("isrc"))),
            "__publisher": any_of((layer == "ddex") & F.contains(msg, F.lit("publisher"))),
            "__short": F.collect_set(quoted).over(w),
        }
    )
    meta = layer == "metadata"
    duplicate = (
        (F.col("__artwork") & meta & (F.contains(msg, F.lit("artwork")) | F.contains(rule, F.lit("artwork"))))
        | (F.col("__isrc") & meta & (F.contains(msg, F.lit("iso 3901")) | F.contains(msg, F.lit("isrc must follow"))))
        | (F.col("__publisher") & meta & F.contains(msg, F.lit("publisher")) & (F.contains(msg, F.lit("required")) | F.contains(msg, F.lit("rights holder"))))
        | ((layer == "fraud") & (F.contains(msg, F.lit("under 60 seconds")) | F.contains(msg, F.lit("sub-60"))) & F.exists("__short", lambda t: F.contains(msg, t)))
    )
    return marked.withColumn("duplicate", F.coalesce(duplicate, F.lit(False))).drop("__artwork", "__isrc", "__publisher", "__short")


def worst_by(findings: DataFrame, keys: list[str], collect: str, into: str) -> DataFrame:
    """The worst severity by keys, and the sorted distinct values of one column."""
    return findings.groupBy(*keys).agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.array_sort(F.collect_set(collect)).alias(into))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def by_severity(findings: DataFrame, alphabetical: bool = False, *more: str) -> DataFrame:
    """Worst first; `alphabetical` sorts the names downwards, as a plain ORDER BY DESC does."""
    order = F.col("severity").desc() if alphabetical else severity_rank(F.col("severity"))
    return findings.orderBy(order, *more)


def resolve(findings: DataFrame, ids: DataFrame, key: str, by: str, resolution: str) -> DataFrame:
    """Findings with those in ids marked as resolved (a rewrite, as tables are immutable)."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    joined = findings.join(hit, key, "left")
    return joined.withColumns(
        {
            "resolved": F.coalesce(F.col("__hit"), F.col("resolved"), F.lit(False)),
            "resolution": F.when(F.col("__hit"), F.lit(resolution)).otherwise(F.col("resolution")),
            "resolved_by": F.when(F.col("__hit"), F.lit(by)).otherwise(F.col("resolved_by")),
        }
    ).drop("__hit")
