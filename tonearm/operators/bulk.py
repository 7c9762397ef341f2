"""Checks of bulk registration files: per row, across rows, against the catalogue; and of ISRC files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from .findings import explode_findings, finding

# Configuration codes of registration files.
NARM_CODES = {
    "00": "LP", "02": "CD", "04": "Cassette Album", "05": "EP", "06": "Mini-Album", "07": "MxCD Single", "20": "7-inch Single",
    "21": "12-inch Single", "22": "Cassette Single", "25": "CD Single", "40": "DVD Video", "41": "DVD Album", "50": "VHS Video",
}
MOST_CHARS, MOST_ABBREVIATION, FUTURE_DAYS, OLD_MONTHS = 255, 10, 183, 24


def release_findings(countries: list[str], today: Column) -> list[Column]:
    """Findings of one row, as columns."""
    c = F.col
    date = I.mmddyy(c("release_date_raw"))
    raw = F.trim(c("release_date_raw"))
    country = F.upper(F.trim(c("country_code")))
    given = lambda name: ~I.blank(c(name))
    narm = F.trim(c("narm_config"))
    problem = I.ean_problem(c("ean"))
    return [
        finding(problem.isNotNull(), "BULK_EAN_FORMAT", "critical", F.concat(F.lit("EAN is not valid: "), problem), "ean", c("ean")),
        finding(I.blank(c("artist")), "BULK_ARTIST_MISSING", "warning", "artist is blank", "artist"),
        finding(F.length("artist") > MOST_CHARS, "BULK_ARTIST_MISSING", "warning", f"artist is longer than {MOST_CHARS} characters", "artist"),
        finding(I.blank(c("title")), "BULK_TITLE_MISSING", "warning", "title is blank", "title"),
        finding(F.length("title") > MOST_CHARS, "BULK_TITLE_MISSING", "warning", f"title is longer than {MOST_CHARS} characters", "title"),
        finding(
            F.coalesce(~raw.rlike("^[0-9]{6}$"), F.lit(True)) | date.isNull(), "BULK_DATE_FORMAT", "critical",
            F.when(F.coalesce(~raw.rlike("^[0-9]{6}$"), F.lit(True)), "date is not MMDDYY").when(~F.substring(raw, 1, 2).try_cast("int").between(1, 12), "month is not 01 to 12").otherwise("no such day"),
            "release_date_raw", c("release_date_raw"),
        ),
        finding(date < F.add_months(today, -OLD_MONTHS), "BULK_DATE_FORMAT", "warning", F.concat(F.lit("date is over two years past: "), F.date_format(date, "MMMM dd, yyyy")), "release_date_raw", c("release_date_raw")),
        finding(I.blank(c("imprint")) & I.blank(c("label")), "BULK_IMPRINT_MISSING", "warning", "neither imprint nor label", "imprint"),
        finding(given("label_abbreviation") & ((F.length("label_abbreviation") > MOST_ABBREVIATION) | ~c("label_abbreviation").rlike("^[A-Za-z0-9 _-]*$")), "BULK_LABEL_ABBR_INVALID", "warning", "abbreviation is too long or has other characters", "label_abbreviation", c("label_abbreviation")),
        finding(given("country_code") & (~country.rlike("^[A-Z]{2}$") | ~country.isin(countries)), "BULK_COUNTRY_CODE_INVALID", "warning", "no such country code", "country_code", c("country_code")),
        finding(I.blank(c("country_code")), "BULK_COUNTRY_CODE_MISSING", "info", "no country code", "country_code"),
        finding(given("narm_config") & ~narm.isin(list(NARM_CODES)), "BULK_NARM_UNKNOWN", "warning", "unknown configuration code", "narm_config", c("narm_config")),
        finding(given("isni") & ~I.isni_valid(c("isni")), "BULK_ISNI_FORMAT", "warning", "ISNI is not 16 digits", "isni", c("isni")),
        finding(I.blank(c("isni")), "BULK_ISNI_MISSING", "info", "no ISNI", "isni"),
        finding(given("iswc") & ~I.iswc_valid(F.trim(c("iswc"))), "BULK_ISWC_FORMAT", "warning", "ISWC is not T-000000000-0", "iswc", c("iswc")),
        finding(I.blank(c("iswc")), "BULK_ISWC_MISSING", "info", "no ISWC", "iswc"),
        finding(date > F.date_add(today, FUTURE_DAYS), "BULK_DATE_FUTURE", "info", F.concat(F.lit("date is far ahead: "), F.date_format(date, "MMMM dd, yyyy")), "release_date_raw", c("release_date_raw")),
    ]


def check_releases(releases: DataFrame, countries: list[str], today: Column, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["row_number", "ean"]
    return explode_findings(releases, keys, release_findings(countries, today))


def check_groups(releases: DataFrame, row: str = "row_number") -> DataFrame:
    """Findings across rows: kind (ean or artist), key, rule_id, severity, message, n_rows and first_row.

    Groups meet as aggregates only, so that a key with many rows stays one row; group_rows() has their members.
    """
    c = F.col
    artist, title = F.lower(F.trim("artist")), F.lower(F.trim("title"))
    by_ean = releases.where(~I.blank(c("ean"))).groupBy(c("ean").alias("key")).agg(
        F.lit("ean").alias("kind"), F.count("*").alias("n_rows"), F.min(row).alias("first_row"),
        F.count_distinct(artist).alias("artists"), F.count_distinct(title).alias("titles"), F.count_distinct("title").alias("spellings"),
    ).where("n_rows > 1")
    given = F.when(~I.blank(c("isni")), F.trim("isni"))
    by_artist = releases.where(~I.blank(c("artist"))).groupBy(artist.alias("key")).agg(
        F.lit("artist").alias("kind"), F.count("*").alias("n_rows"), F.min(row).alias("first_row"), F.count(given).alias("with_isni"), F.count_distinct(given).alias("isnis")
    ).where("n_rows > 1")
    keys = ["kind", "key", "n_rows", "first_row"]
    return explode_findings(by_ean, keys, [
        finding(F.lit(True), "BULK_EAN_DUPLICATE", "critical", F.concat(F.lit("EAN occurs "), c("n_rows"), F.lit(" times")), "ean", c("key")),
        finding(c("artists") > 1, "BULK_ARTIST_INCONSISTENT", "warning", "one EAN, several artists", "artist", c("key")),
        finding((c("titles") > 1) | (c("spellings") > 1), "BULK_TITLE_INCONSISTENT", "warning", F.when(c("titles") > 1, "one EAN, several titles").otherwise("titles differ in case only"), "title", c("key")),
    ]).unionByName(explode_findings(by_artist, keys, [
        finding((c("with_isni") > 0) & (c("with_isni") < c("n_rows")), "BULK_ISNI_INCONSISTENT", "warning", "artist with and without ISNI", "isni", c("key")),
        finding((c("with_isni") == c("n_rows")) & (c("isnis") > 1), "BULK_ISNI_CONFLICTING", "critical", "artist with several ISNIs", "isni", c("key")),
    ]))


def group_rows(releases: DataFrame, row: str = "row_number") -> DataFrame:
    """kind, key and row of each row: members of the groups that check_groups() judges."""
    kinds = F.array_compact(F.array(
        F.when(~I.blank(F.col("ean")), F.struct(F.lit("ean").alias("kind"), F.col("ean").alias("key"))),
        F.when(~I.blank(F.col("artist")), F.struct(F.lit("artist").alias("kind"), F.lower(F.trim("artist")).alias("key"))),
    ))
    return releases.select(F.explode(kinds).alias("__g"), row).select("__g.*", row)


def check_isrcs(records: DataFrame, countries: list[str], keys: list[str] | None = None) -> DataFrame:
    """Findings of each row of an ISRC file; a missing country is a warning here."""
    c = F.col
    country = F.upper(F.trim(c("country_code")))
    return explode_findings(records, keys or ["row_number", "isrc"], [
        finding(~I.isrc_valid(c("isrc")), "ISRC_FORMAT", "critical", "ISRC is not CC-XXX-YY-NNNNN", "isrc", c("isrc")),
        finding(I.blank(c("artist")), "ISRC_ARTIST_MISSING", "warning", "artist is blank", "artist"),
        finding(I.blank(c("title")), "ISRC_TITLE_MISSING", "warning", "title is blank", "title"),
        finding(~F.coalesce(F.trim("release_date_raw").rlike("^[0-9]{6}$"), F.lit(False)), "ISRC_DATE_FORMAT", "critical", "date is not MMDDYY", "release_date_raw", c("release_date_raw")),
        finding(F.length("label_abbreviation") > MOST_ABBREVIATION, "ISRC_LABEL_ABBR_INVALID", "warning", "abbreviation is too long", "label_abbreviation", c("label_abbreviation")),
        finding(~I.blank(c("country_code")) & (~country.rlike("^[A-Z]{2}$") | ~country.isin(countries)), "ISRC_COUNTRY_CODE_INVALID", "warning", "no such country code", "country_code", c("country_code")),
        finding(I.blank(c("country_code")), "ISRC_COUNTRY_CODE_MISSING", "warning", "no country code", "country_code"),
    ])


def duplicate_isrcs(records: DataFrame, row: str = "row_number") -> DataFrame:
    """A row for each record whose ISRC occurs more than once: isrc_key, n (its records) and the record's row."""
    keyed = records.where(~I.blank(F.col("isrc"))).select(I.isrc_key(F.col("isrc")).alias("isrc_key"), row)
    return keyed.join(keyed.groupBy("isrc_key").agg(F.count("*").alias("n")).where("n > 1"), "isrc_key").select("isrc_key", "n", row)


def artist_mismatches(records: DataFrame, releases: DataFrame) -> DataFrame:
    """ISRC-file artists that equal no EAN-file artist but contain one, or are contained: artist and the first such (by row).

    A name that is contained has all its trigrams (itself, if it is shorter) in the other: the join is on the contained
    name's least frequent one, so both sides meet by a key.
    """
    mine = records.select(F.lower(F.trim("artist")).alias("artist")).where("artist <> ''").distinct()
    theirs = releases.select(F.lower(F.trim("artist")).alias("other"), "row_number").where("other <> ''").groupBy("other").agg(F.min("row_number").alias("row_number"))
    mine = mine.join(theirs, mine["artist"] == theirs["other"], "left_anti")

    def pieces(c, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))

    def own(df, name):
        c = F.col(name)
        return df.withColumn("g", F.explode(F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(pieces(c, 3)))))

    def inside(df, name):
        c = F.col(name)
        return df.withColumn("g", F.explode(F.array_distinct(F.concat(pieces(c, 1), pieces(c, 2), pieces(c, 3)))))

    has_a, has_b = inside(mine, "artist"), inside(theirs, "other")
    count = has_a.select("g").unionByName(has_b.select("g")).groupBy("g").agg(F.count("*").alias("n"))
    rare = lambda df, *keys: df.join(count, "g").groupBy(*keys).agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    pairs = rare(own(mine, "artist"), "artist").join(has_b, "g").select("artist", "other", "row_number")
    pairs = pairs.unionByName(rare(own(theirs, "other"), "other", "row_number").join(has_a, "g").select("artist", "other", "row_number"))
    hit = pairs.where(F.contains("artist", F.col("other")) | F.contains("other", F.col("artist")))
    return hit.groupBy("artist").agg(F.min_by("other", F.struct("row_number", "other")).alias("other"))


def catalogue_conflicts(current: DataFrame, history: DataFrame) -> DataFrame:
    """Conflicts of the current file with history rows of its organisation: ean, rule_id, severity and the earliest differing row.

    current: org_id, ean, artist, title, isni. history: the same with first_seen, scan_id and is_demo.
    """
    past = history.where(~F.coalesce("is_demo", F.lit(False)) & F.col("scan_id").isNotNull())
    norm = lambda df, p: df.select("org_id", "ean", X.normalize_artist(F.col("artist")).alias(f"{p}artist"), X.normalize_title(F.col("title")).alias(f"{p}title"), F.nullif(F.trim("isni"), F.lit("")).alias(f"{p}isni"), *([] if p == "c_" else ["first_seen", "scan_id"]))
    now = norm(current, "c_").dropDuplicates(["org_id", "ean"])
    joined = norm(past, "h_").join(now, ["org_id", "ean"])
    kinds = F.array_compact(F.array(
        F.when((F.col("c_artist") != "") & (F.col("h_artist") != "") & (F.col("c_artist") != F.col("h_artist")), F.struct(F.lit("CROSS_CATALOG_EAN_CONFLICT").alias("rule_id"), F.lit("critical").alias("severity"), F.col("h_artist").alias("theirs"))),
        F.when(F.col("c_title") != F.col("h_title"), F.struct(F.lit("CROSS_CATALOG_TITLE_CONFLICT").alias("rule_id"), F.lit("warning").alias("severity"), F.col("h_title").alias("theirs"))),
        F.when(F.col("c_isni") != F.col("h_isni"), F.struct(F.lit("CROSS_CATALOG_ISNI_CONFLICT").alias("rule_id"), F.lit("critical").alias("severity"), F.col("h_isni").alias("theirs"))),
    ))
    hit = joined.select("org_id", "ean", "first_seen", "scan_id", F.explode(kinds).alias("k")).select("org_id", "ean", "first_seen", "scan_id", "k.*")
    return hit.groupBy("org_id", "ean", "rule_id", "severity").agg(F.min_by(F.struct("first_seen", "scan_id", "theirs"), F.struct("first_seen", "scan_id", "theirs")).alias("h")).select("org_id", "ean", "rule_id", "severity", "h.*")


def artist_variants(history: DataFrame, keys: list[str], artist: str = "artist") -> DataFrame:
    """Normalised artists with two spellings or more."""
    g = history.withColumn("artist_normalized", X.normalize_artist(F.col(artist))).where("artist_normalized <> ''")
    return g.groupBy(*keys, "artist_normalized").agg(F.count_distinct(artist).alias("n_variants"), F.array_join(F.array_sort(F.collect_set(artist)), "|").alias("variants"), F.count("*").alias("n_rows")).where("n_variants > 1")


def artist_variant_findings(current: DataFrame, history: DataFrame) -> DataFrame:
    """Artists of the current file that history spells in two ways or more: org_id, row_number (their first), ean, and up to four spellings.

    current: org_id, row_number, ean, artist. history: org_id, artist, scan_id and is_demo.
    """
    past = history.where(~F.coalesce("is_demo", F.lit(False)) & F.col("scan_id").isNotNull())
    spelled = past.select("org_id", X.normalize_artist(F.col("artist")).alias("artist_normalized"), "artist").where("artist_normalized <> ''").distinct()
    groups = spelled.groupBy("org_id", "artist_normalized").agg(F.array_sort(F.collect_set("artist")).alias("__v")).where(F.size("__v") > 1)
    now = current.withColumn("artist_normalized", X.normalize_artist(F.col("artist"))).groupBy("org_id", "artist_normalized").agg(F.min_by(F.struct("row_number", "ean", "artist"), "row_number").alias("c"))
    found = now.join(groups, ["org_id", "artist_normalized"])
    names = F.when(F.array_contains("__v", F.col("c.artist")), F.col("__v")).otherwise(F.array_union(F.array("c.artist"), "__v"))
    return found.select(
        "org_id", "c.row_number", "c.ean", "artist_normalized", F.lit("CROSS_CATALOG_ARTIST_VARIANT").alias("rule_id"), F.lit("warning").alias("severity"),
        F.concat(F.lit("artist is spelled in several ways: "), F.array_join(F.slice(names, 1, 4), " | ")).alias("message"),
    )


def clean_rows(releases: DataFrame, row_issues: DataFrame, group_issues: DataFrame, row: str = "row_number", ean: str = "ean") -> DataFrame:
    """Rows with neither an issue of their own nor one of their EAN."""
    shared = group_issues.where("kind = 'ean'").select(F.col("key").alias(ean)).distinct()
    return releases.join(row_issues.select(row).distinct(), row, "left_anti").join(shared, ean, "left_anti")


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
