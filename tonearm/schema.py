"""Types and orders shared by sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities, worst first.
SEVERITIES = ("critical", "error", "warning", "info")
GRADES = ((80.0, "PASS"), (60.0, "WARN"))

FINDING = "struct<rule_id:string,severity:string,message:string,field:string,actual:string>"

TRACK = (
    "array<struct<isrc:string,title:string,track_number:int,duration_ms:bigint,composer:string,lyricist:string,"
    "producer:string,mix_engineer:string,explicit:boolean,language:string,track_version:string,publisher:string,artist:string>>"
)

#: One release, flat. Empty text and 0 mean "not measured".
RELEASE_DEFAULTS: dict[str, object] = {
    **dict.fromkeys(("title", "artist", "upc", "label", "release_date", "release_type", "genre", "language", "c_line", "p_line", "p_line_year", "publisher"), ""),
    **dict.fromkeys(("territory", "commercial_model", "parental_warning", "artwork_format", "artwork_color_mode", "apple_id", "iswc", "preorder_date", "artist_image_url", "video_codec"), ""),
    **dict.fromkeys(("artwork_width", "artwork_height", "sample_rate", "bit_depth", "preview_start_time", "video_width", "video_height"), 0),
    **dict.fromkeys(("loudness_lufs", "true_peak_dbtp"), 0.0),
    **dict.fromkeys(("has_dolby_atmos", "is_hi_res"), False),
    **dict.fromkeys(("isrc_list", "composers"), []),
}

BULK = "row_number int, ean string, artist string, title string, release_date_raw string, imprint string, label string, narm_config string, label_abbreviation string, country_code string, isni string, iswc string"


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def with_release_defaults(df):
    """Every release field present and never null, so that compiled predicates meet no SQL null."""
    out = {}
    for name, default in RELEASE_DEFAULTS.items():
        if isinstance(default, list):
            value = F.array().cast("array<string>")
        else:
            value = F.lit(default)
        out[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(out)
