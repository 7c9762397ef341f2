"""Enrichment from local reference tables instead of network lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import similarity as S
from ..functions import text as X

ACCEPT, HIGH, MISMATCH = 0.70, 0.90, 0.70


def best_candidates(tracks: DataFrame, candidates: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The best candidate of each track by 0.6 title + 0.4 artist similarity, if it is at least ACCEPT.

    candidates: key, candidate_id, pos, c_title, c_artist; the first `most` by pos are compared, as a search page would show.
    """
    w = Window.partitionBy(key).orderBy("pos", "candidate_id")
    page = candidates.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    scored = tracks.join(page, key).withColumn("score", 0.6 * S.sequence_ratio(F.col("title"), F.col("c_title")) + 0.4 * S.sequence_ratio(F.col("artist"), F.col("c_artist")))
    best = scored.groupBy(key).agg(F.max_by(F.struct("candidate_id", "score"), F.struct("score", -F.col("pos"))).alias("b")).select(key, "b.*")
    return best.where(F.col("score") >= ACCEPT).withColumn("confidence", F.when(F.col("score") >= HIGH, "high").otherwise("medium"))


def isrc_lookup(tracks: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """status of each track's ISRC: invalid, not_found, mismatch or ok. recordings: isrc, r_title; of those of one ISRC the smallest title counts."""
    ref = recordings.groupBy(I.isrc_key(F.col("isrc")).alias("__k")).agg(F.min("r_title").alias("r_title"))
    joined = tracks.withColumn("__k", I.isrc_key(F.col("isrc"))).join(ref, "__k", "left")
    likeness = S.sequence_ratio(F.col("title"), F.col("r_title"))
    status = F.when(~I.isrc_valid(F.col("isrc")), "invalid").when(F.col("r_title").isNull(), "not_found").when(likeness < MISMATCH, "mismatch").otherwise("ok")
    return joined.select(key, "isrc", status.alias("status"))


def dictionary_match(releases: DataFrame, artists: DataFrame, works: DataFrame) -> DataFrame:
    """isni and iswc suggestions by normalised names, and whether anything was found. artists: name, isni; works: title, iswc."""
    a = artists.select(X.normalize_artist(F.col("name")).alias("__a"), F.col("isni").alias("found_isni")).dropDuplicates(["__a"])
    t = works.select(X.normalize_title(F.col("title")).alias("__t"), F.col("iswc").alias("found_iswc")).dropDuplicates(["__t"])
    out = releases.withColumns({"__a": X.normalize_artist(F.col("artist")), "__t": X.normalize_title(F.col("title"))}).join(a, "__a", "left").join(t, "__t", "left")
    grouped = F.regexp_replace(F.regexp_replace("found_isni", "[^0-9X]", ""), "(....)(?=.)", "$1 ")
    status = F.when(F.col("found_isni").isNotNull() | F.col("found_iswc").isNotNull(), "enriched").otherwise("not_found")
    return out.withColumns({"isni_display": grouped, "enrichment_status": status}).drop("__a", "__t")


def new_composers(tracks: DataFrame, key: str, current: str = "composers", found: str = "found_composers") -> DataFrame:
    return tracks.select(key, F.array_except(F.array_distinct(found), F.coalesce(F.col(current), F.array().cast("array<string>"))).alias("suggested")).where(F.size("suggested") > 0)


def credit(artists) -> object:
    """Names with their joining phrases, in order. artists: array<struct<name, joinphrase>>."""
    return F.array_join(F.transform(artists, lambda x: F.concat(x["name"], F.coalesce(x["joinphrase"], F.lit("")))), "")


def label_suggestion(releases: DataFrame, key: str) -> DataFrame:
    """medium where the label is absent, low where it is unlike the one found."""
    absent = I.blank(F.col("label"))
    unlike = S.sequence_ratio(F.col("label"), F.col("found_label")) < MISMATCH
    return releases.where(~I.blank(F.col("found_label"))).select(key, F.when(absent, "medium").when(unlike, "low").alias("confidence"), F.col("found_label").alias("suggested")).where("confidence is not null")
