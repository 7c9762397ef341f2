"""Release metadata from CSV and JSON uploads: one row a release with its tracks, and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators.findings import explode_findings, finding
from ..schema import FINDING

# Columns of metadata files.
REQUIRED = ("release_title", "artist_name", "upc", "release_date", "label_name", "isrc", "track_title", "track_number", "duration")
OPTIONAL = (
    "release_type", "genre", "parental_warning", "c_line", "p_line", "territory", "commercial_model", "use_type", "start_date", "end_date",
    "composer", "lyricist", "producer", "mix_engineer", "explicit", "language", "track_version", "resource_reference",
)


# What an ISRC, a date and whole numbers look like in metadata files.
FILE_ISRC = r"^[A-Z]{2}-?[A-Z0-9]{3}-?\d{2}-?\d{5}$"
FILE_DATE = r"^\d{4}-\d{2}-\d{2}$"
WHOLE = r"^[+-]?\d+(_\d+)*$"


def whole_number(c: Column) -> Column:
    """A whole number written in digits, with a sign or underscores between them; else null."""
    c = F.trim(c)
    return F.when(c.rlike(WHOLE), F.replace(c, F.lit("_"), F.lit("")).try_cast("long"))


# ------------------------------------------------------------------ CSV
def missing_columns(columns: list[str]) -> list[str]:
    return sorted(set(REQUIRED) - {c.strip().lower() for c in columns})


def csv_findings(rows: DataFrame) -> DataFrame:
    """Findings of the rows of `uploads` (kind csv): path, line (null: of the file or a release), rule_id, severity, message, field, actual.

    A row without UPC has no further finding; a release's title is that of its first row. Each row is a track, so no release is without tracks.
    """
    c = F.col
    given = F.col("fault").isNull() & ~I.blank(c("upc"))
    odd = lambda name, pattern: given & ~I.blank(c(name)) & ~c(name).rlike(pattern)
    per_row = explode_findings(rows, ["path", "line"], [
        finding(c("fault") == "encoding", "csv.encoding", "critical", "file is not UTF-8"),
        finding(c("fault") == "empty", "csv.empty", "critical", "file has no header"),
        finding(c("fault") == "missing_columns", "csv.missing_columns", "critical", F.concat(F.lit("missing: "), F.array_join("missing", ", "))),
        finding(c("fault").isNull() & I.blank(c("upc")), "csv.missing_upc", "error", "row has no UPC", "upc"),
        finding(odd("upc", I.UPC), "csv.upc_format", "error", "UPC is not 12 or 13 digits", "upc", c("upc")),
        finding(odd("isrc", FILE_ISRC), "csv.isrc_format", "error", "ISRC is not CC-XXX-YY-NNNNN", "isrc", c("isrc")),
        finding(odd("release_date", FILE_DATE), "csv.date_format", "error", "date is not YYYY-MM-DD", "release_date", c("release_date")),
        finding(odd("track_number", WHOLE), "csv.track_number", "error", "track number is not a whole number", "track_number", c("track_number")),
        finding(odd("duration", r"^\d{1,3}:\d{2}$"), "csv.duration_format", "warning", "duration is not MM:SS", "duration", c("duration")),
    ])
    untitled = rows.where(given).groupBy("path", "upc").agg(F.min_by("release_title", "line").alias("title")).where(I.blank(c("title")))
    return per_row.unionByName(untitled.select("path", F.lit(None).cast("long").alias("line"), F.lit("csv.missing_release_title").alias("rule_id"), F.lit("error").alias("severity"), F.lit("release has no title").alias("message"), F.lit("release_title").alias("field"), c("upc").alias("actual")))


def releases_of_csv(rows: DataFrame) -> DataFrame:
    """One row a UPC of a file: the first row's release fields, and the tracks in order."""
    names = ["release_title", "artist_name", "release_date", "label_name", "release_type", "genre", "parental_warning", "c_line", "p_line", "territory", "commercial_model", "use_type", "start_date", "end_date"]
    track = F.struct(
        "line", "isrc", F.col("track_title").alias("title"), whole_number(F.col("track_number")).alias("track_number"), I.mmss_ms(F.col("duration")).alias("duration_ms"), "composer", "lyricist", "producer",
        "mix_engineer", F.coalesce(F.lower("explicit").isin("true", "yes", "1"), F.lit(False)).alias("explicit"), "language", "track_version", "resource_reference",
    )
    g = rows.where(F.col("fault").isNull() & ~I.blank(F.col("upc"))).groupBy("path", "upc").agg(F.min_by(F.struct(*names), "line").alias("r"), F.array_sort(F.collect_list(track)).alias("tracks"))
    out = g.select("path", "upc", "r.*", "tracks").withColumnsRenamed({"release_title": "title", "artist_name": "artist", "label_name": "label"})
    usual = lambda name, value: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)).alias(name)
    return out.withColumns({"release_type": usual("release_type", "Album"), "territory": usual("territory", "Worldwide"), "isrc_list": F.array_compact(F.transform("tracks", lambda t: F.nullif(t["isrc"], F.lit(""))))})


# ------------------------------------------------------------------ JSON
# Fields of releases, tracks and deals in JSON.
JSON_NEEDED = ("upc", "title", "artist", "label", "release_date")
JSON_FIELDS = ("release_type", "genre", "parental_warning", "c_line", "p_line", "language", "publisher")
JSON_TRACK = ("composer", "lyricist", "producer", "mix_engineer", "explicit", "language", "track_version")
JSON_DEAL = ("territory", "commercial_model", "use_type", "start_date", "end_date")


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _items(v: Column) -> Column:
    """Elements of a JSON array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _fields(v: Column) -> Column:
    """Fields of a JSON object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    return _fields(v).isNotNull()


def _text(v: Column) -> Column:
    """A value as text, trimmed; null if it is absent or null."""
    return F.trim(F.try_variant_get(v, "$", "string"))


def _each(values: Column, made) -> Column:
    """made(x) of each value. What made() makes for a later _each() is made once, however often that names it."""
    return F.transform(values, made)


def _known(*values: Column) -> Column:
    """An array of v, kind, text (trimmed) and nothing (absent, null, false, zero, or an empty text, array or object) of each value; each is looked at once.

    Schemas are made of plain values only: that of an array or object costs a walk through all of it.
    """
    kind = lambda x: F.when(_items(x).isNotNull(), "ARRAY").when(_fields(x).isNotNull(), "OBJECT").otherwise(F.schema_of_variant(x))
    kinds = _each(F.array(*values), lambda x: F.struct(x.alias("v"), kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("raw")))
    nothing = lambda v, kind, raw: v.isNull() | F.coalesce(
        F.when(kind == "VOID", True).when(kind == "ARRAY", F.size(_items(v)) == 0).when(kind == "OBJECT", F.size(_fields(v)) == 0).when(kind == "BOOLEAN", raw == "false").when(kind == "STRING", raw == "")
        .when(kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(v, "$", "double") == 0), F.lit(False)
    )
    return _each(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), F.trim(x["raw"]).alias("text"), nothing(x["v"], x["kind"], x["raw"]).alias("nothing")))


def _not_whole(x: Column) -> Column:
    """Whether a known value is given but no whole number can be made of it: texts that aren't digits, arrays and objects."""
    return F.coalesce(x["kind"].isin("ARRAY", "OBJECT") | (x["kind"] == "STRING") & ~x["text"].rlike(WHOLE), F.lit(False))


def _whole(x: Column) -> Column:
    return F.when(x["kind"] == "STRING", whole_number(x["text"])).when(x["kind"] == "BOOLEAN", F.when(x["text"] == "true", 1).otherwise(0).cast("long")).otherwise(F.try_variant_get(x["v"], "$", "double").try_cast("long"))


def parse_json_uploads(files: DataFrame) -> DataFrame:
    """path, fault (encoding, parse, structure; null) and pos and v, the releases of a text of one or an array of them. Each text is parsed once.

    files: path, text, and fault where a source gives one. Texts with NaN or a key twice in an object count as no JSON.
    """
    fault = F.col("fault") if "fault" in files.columns else F.lit(None).cast("string")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\ufeff", "")
    parsed = files.select("path", fault.alias("given"), F.try_parse_json(body).alias("j"))
    parsed = parsed.withColumn("list", F.when(_is_object(F.col("j")), F.array("j")).otherwise(_items(F.col("j"))))
    wrong = F.coalesce("given", F.when(F.col("j").isNull(), "parse").when(F.col("list").isNull(), "structure"))
    return parsed.select("path", wrong.alias("fault"), F.posexplode_outer("list").alias("pos", "v"))


def releases_of_json(files: DataFrame) -> DataFrame:
    """path, pos, fault, broken (the text is no JSON), release (its fields, tracks and deals as given) and tracks."""
    v = F.col("v")
    track = lambda t: F.struct(t.alias("t"), _known(_get(t, "track_number"), _get(t, "duration_ms")).alias("n"))
    of_track = lambda x: F.struct(
        *[F.nullif(_text(_get(x["t"], k)), F.lit("")).alias(k) for k in ("isrc", "title")], _whole(x["n"][0]).cast("int").alias("track_number"), _whole(x["n"][1]).alias("duration_ms"), *[_text(_get(x["t"], k)).alias(k) for k in JSON_TRACK]
    )
    deal = lambda d: F.struct(*[_text(_get(d, k)).alias(k) for k in JSON_DEAL])
    objects = lambda name: F.filter(_items(_get(v, name)), _is_object)
    made = lambda needed: F.struct(*[F.when(~needed[i]["nothing"], needed[i]["text"]).alias(k) for i, k in enumerate(JSON_NEEDED)], *[_text(_get(v, k)).alias(k) for k in JSON_FIELDS], F.transform(objects("deals"), deal).alias("deals"))
    release = _each(F.array(_known(*[_get(v, k) for k in JSON_NEEDED])), made)[0]
    tracks = _each(_each(F.coalesce(objects("tracks"), F.array().cast("array<variant>")), track), of_track)
    return parse_json_uploads(files).select("path", "pos", "fault", F.col("fault").eqNullSafe("parse").alias("broken"), F.when(_is_object(v), release).alias("release"), F.when(_is_object(v), tracks).alias("tracks"))


def json_findings(files: DataFrame) -> DataFrame:
    """Findings of JSON texts: path, pos (of the release), rule_id, severity, message, field (its path in the release), actual; one pass, one explode."""
    v, fault, pos = F.col("v"), F.col("fault"), F.col("pos")
    at = lambda *parts: F.concat(F.lit("releases["), pos.cast("string"), F.lit("]"), *parts)
    of_file = [finding(fault == "encoding", "json.encoding", "critical", "file is not UTF-8"), finding(fault == "parse", "json.parse", "critical", "text is not JSON"), finding(fault == "structure", "json.structure", "critical", "neither a release nor an array of releases")]

    def of_track(x: Column, i: Column) -> Column:
        is_track, isrc, title, number, duration = x["is_track"], *[x["known"][n] for n in range(4)]
        each = [
            finding(~is_track, "json.track_type", "error", "a track is not an object"), finding(is_track & isrc["nothing"], "json.track.missing_isrc", "error", "no isrc", "isrc"), finding(is_track & title["nothing"], "json.track.missing_title", "error", "no title", "title"),
            finding(is_track & ~isrc["nothing"] & (isrc["text"] != "") & ~isrc["text"].rlike(FILE_ISRC), "json.track.isrc_format", "error", "ISRC is not CC-XXX-YY-NNNNN", "isrc", isrc["text"]),
            finding(is_track & _not_whole(number), "json.track.track_number", "warning", "not a whole number", "track_number", number["text"]), finding(is_track & _not_whole(duration), "json.track.duration_ms", "warning", "not a whole number", "duration_ms", duration["text"]),
        ]
        place = F.concat(F.lit("tracks["), i.cast("string"), F.lit("]"))
        return F.transform(F.array_compact(F.array(*each)), lambda f: f.withField("field", F.when(f["field"] == "", place).otherwise(F.concat(place, F.lit("."), f["field"]))))

    def of_release(x: Column) -> Column:
        known = {k: x[i] for i, k in enumerate((*JSON_NEEDED, "deals", "tracks"))}
        upc, date, deals, tracks = known["upc"], known["release_date"], known["deals"], known["tracks"]
        odd = lambda x, pattern: ~x["nothing"] & (x["text"] != "") & ~x["text"].rlike(pattern)
        each = [finding(known[k]["nothing"], f"json.missing_{k}", "error", f"no {k}", k) for k in JSON_NEEDED] + [
            finding(odd(upc, I.UPC), "json.upc_format", "error", "UPC is not 12 or 13 digits", "upc", upc["text"]), finding(odd(date, FILE_DATE), "json.date_format", "error", "date is not YYYY-MM-DD", "release_date", date["text"]),
            finding(~deals["kind"].isin("VOID", "ARRAY"), "json.deals_type", "warning", "deals are not an array", "deals"),
            finding(tracks["nothing"], "json.no_tracks", "error", "no tracks", "tracks"), finding(~tracks["nothing"] & (tracks["kind"] != "ARRAY"), "json.tracks_type", "error", "tracks are not an array", "tracks"),
        ]
        track = lambda t: F.struct(_is_object(t).alias("is_track"), _known(*[_get(t, k) for k in ("isrc", "title", "track_number", "duration_ms")]).alias("known"))
        of_tracks = F.flatten(F.transform(_each(_items(tracks["v"]), track), of_track))
        return F.concat(F.array_compact(F.array(*each)), F.coalesce(of_tracks, F.array().cast(of_type())))

    release = _each(F.array(_known(*[_get(v, k) for k in (*JSON_NEEDED, "deals", "tracks")])), of_release)[0]
    no_release = F.array_compact(F.array(finding(pos.isNotNull(), "json.release_type", "error", "a release is not an object")))
    found = F.when(fault.isNotNull(), F.array_compact(F.array(*of_file))).when(_is_object(v), release).otherwise(no_release)
    rows = parse_json_uploads(files).select("path", "pos", F.explode(found).alias("f"))
    rows = rows.select("path", "pos", "f.*")
    return rows.withColumn("field", F.when(pos.isNotNull(), F.when(F.col("field") == "", at()).otherwise(at(F.lit("."), F.col("field")))).otherwise(""))


def of_type() -> str:
    return f"array<{FINDING if isinstance(FINDING, str) else FINDING.simpleString()}>"


def fill_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each field filled from the first of its aliases that isn't blank; names of columns compare without case, blanks, dashes and underscores."""
    plain = lambda s: "".join(x for x in s.lower() if x not in " _-")
    there = {plain(c): c for c in reversed(df.columns)}
    given = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    made = {field: F.coalesce(*[given(there[plain(a)]) for a in [field, *names] if plain(a) in there], F.lit(None).cast("string")) for field, names in aliases.items()}
    return df.withColumns(made)
