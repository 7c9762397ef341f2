"""Audio and artwork checks on measured columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import explode_findings, finding

# What platforms accept. name: formats, bit depth, sample rate, preferred rates, loudness low and high, true peak, seconds.
PLATFORMS = {
    "spotify": (["wav", "flac", "mp3", "ogg", "aac", "m4a"], 16, 44100, [44100, 48000], -18.0, -9.0, -1.0, 0),
    "apple": (["wav", "aiff", "aif", "alac", "flac", "m4a"], 16, 44100, [44100, 48000, 88200, 96000, 192000], -20.0, -12.0, -1.0, 0),
    "youtube": (["wav", "flac", "mp3", "aac", "m4a", "ogg"], 16, 48000, [48000, 44100], -18.0, -10.0, -1.0, 0),
    "amazon": (["wav", "flac", "aiff", "aif", "alac", "m4a"], 16, 44100, [44100, 48000, 88200, 96000, 192000], -18.0, -9.0, -1.0, 0),
    "tiktok": (["wav", "mp3", "flac", "aac", "m4a", "ogg"], 16, 44100, [44100, 48000], -18.0, -10.0, -1.0, 60),
}
MOST_BYTES, LEAST_SIDE, GOOD_SIDE = 10 * 1024 * 1024, 3000, 4000
# Seconds of silence at a start or an end that are still fine, the true peak from which a track counts as clipped.
MOST_SILENCE, CLIPPING_DBTP = 2.0, -1.0
MOST_PLATFORMS = 10_000


def platform_table(spark, platforms: dict = PLATFORMS) -> DataFrame:
    rows = [(k, *v) for k, v in platforms.items()]
    return spark.createDataFrame(rows, "platform string, formats array<string>, min_bits int, min_rate int, rates array<int>, low double, high double, peak double, min_seconds int")


def audio_findings(tracks: DataFrame, platforms: DataFrame, keys: list[str]) -> DataFrame:
    """Findings by track and platform: each track meets each platform once. Up to MOST_PLATFORMS of them are broadcast; beyond it the product is left to Spark."""
    c = F.col
    few = platforms.count() <= MOST_PLATFORMS
    both = tracks.crossJoin(F.broadcast(platforms) if few else platforms)
    measured = lambda name: F.coalesce(c(name), F.lit(0)) != 0
    found = explode_findings(both, [*keys, "platform"], [
        finding(~F.array_contains("formats", F.lower("format")), "format_not_accepted", "critical", "format is not accepted", "format", c("format")),
        finding(measured("sample_rate") & (c("sample_rate") < c("min_rate")), "sample_rate_too_low", "critical", "sample rate is too low", "sample_rate", c("sample_rate")),
        finding(measured("sample_rate") & (c("sample_rate") >= c("min_rate")) & ~F.array_contains("rates", c("sample_rate")), "sample_rate_not_preferred", "info", "sample rate is not preferred", "sample_rate", c("sample_rate")),
        finding(measured("bit_depth") & (c("bit_depth") < c("min_bits")), "bit_depth_too_low", "critical", "bit depth is too low", "bit_depth", c("bit_depth")),
        finding(measured("true_peak") & (c("true_peak") > c("peak")), "true_peak_exceeded", "critical", "true peak is too high", "true_peak", c("true_peak")),
        finding(measured("loudness") & (c("loudness") < c("low")), "loudness_too_quiet", "warning", "too quiet", "loudness", c("loudness")),
        finding(measured("loudness") & (c("loudness") > c("high")), "loudness_too_loud", "warning", "too loud", "loudness", c("loudness")),
        finding((c("min_seconds") > 0) & (c("seconds") < c("min_seconds")), "duration_too_short", "warning", "too short", "seconds", c("seconds")),
    ])
    return found.withColumn("rule_id", F.concat("platform", F.lit(".audio."), "rule_id"))


def measured_findings(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Findings by track alone: clipping, and silence at either end. tracks: true_peak, leading_silence and trailing_silence (seconds)."""
    c = F.col
    return explode_findings(tracks, keys, [
        finding(c("true_peak") > CLIPPING_DBTP, "universal.audio.true_peak_clipping", "critical", "true peak is over -1 dBTP", "true_peak", c("true_peak")),
        finding(c("leading_silence") > MOST_SILENCE, "universal.audio.silence_at_start", "info", "silence at the start", "leading_silence", c("leading_silence")),
        finding(c("trailing_silence") > MOST_SILENCE, "universal.audio.silence_at_end", "info", "silence at the end", "trailing_silence", c("trailing_silence")),
    ])


# File extensions taken as formats, names that probes give formats, bits of PCM codecs.
EXTENSIONS = ["wav", "flac", "mp3", "aac", "ogg", "aiff", "aif", "m4a", "alac", "opus"]
PROBED = {"wav": "wav", "w64": "wav", "flac": "flac", "mp3": "mp3", "mpeg": "mp3", "aac": "aac", "adts": "aac", "ogg": "ogg", "aiff": "aiff", "ipod": "m4a", "opus": "opus"}
CODEC_BITS = {"pcm_s16le": 16, "pcm_s16be": 16, "pcm_s24le": 24, "pcm_s24be": 24, "pcm_s32le": 32, "pcm_s32be": 32, "pcm_f32le": 32, "pcm_f32be": 32}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def audio_format(file_name: Column, probed: Column) -> Column:
    """The file's extension if it names a format, else the probe's first name."""
    extension = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    first = F.trim(F.element_at(F.split(probed, ","), 1))
    return F.when(extension.isin(EXTENSIONS), extension).otherwise(F.coalesce(_map(PROBED)[first], first))


def bit_depth(per_sample: Column, per_raw_sample: Column, codec: Column) -> Column:
    """Bits of a sample: as measured, as stored, or as the codec's name tells; null for lossy codecs."""
    given = lambda c: F.when(c.cast("int") > 0, c.cast("int"))
    return F.coalesce(given(per_sample), given(per_raw_sample), _map(CODEC_BITS)[F.lower(codec)])


def peak_dbfs(samples: Column) -> Column:
    """Sample peak in dB of full scale, two decimals; null for silence or nothing."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.round(F.lit(20.0) * F.log10(F.when(peak > 0, peak)), 2)


def artwork_findings(art: DataFrame, keys: list[str]) -> DataFrame:
    """art: format, file_size_bytes, width, height, color_mode, dpi_x."""
    c = F.col
    known = (c("width") > 0) & (c("height") > 0)
    side = F.least("width", "height")
    return explode_findings(art, keys, [
        finding(c("format").isNull(), "universal.artwork.format_undetected", "critical", "format is unknown", "format"),
        finding(~F.lower("format").isin("jpeg", "png"), "universal.artwork.format_not_accepted", "critical", "neither JPEG nor PNG", "format", c("format")),
        finding(c("file_size_bytes") > MOST_BYTES, "universal.artwork.file_size_too_large", "critical", "file is over 10 MiB", "file_size_bytes", c("file_size_bytes")),
        finding(known & (side < LEAST_SIDE), "universal.artwork.resolution_too_low", "critical", "a side is under 3000 pixels", "width", side),
        finding(known & (side >= LEAST_SIDE) & (side < GOOD_SIDE), "universal.artwork.resolution_below_recommended", "info", "a side is under 4000 pixels", "width", side),
        finding(known & (F.abs(F.try_divide(c("width").cast("double"), c("height")) - 1) > 0.01), "universal.artwork.not_square", "critical", "not square", "width", F.concat_ws("x", "width", "height")),
        finding(c("color_mode") == "CMYK", "universal.artwork.cmyk_color_space", "critical", "CMYK colours", "color_mode", c("color_mode")),
        finding(c("color_mode") == "P", "universal.artwork.palette_color_mode", "critical", "palette colours", "color_mode", c("color_mode")),
        finding(c("color_mode").isin("L", "1"), "universal.artwork.grayscale_color_mode", "warning", "grey", "color_mode", c("color_mode")),
        finding(c("color_mode").isin("RGBA", "LA"), "universal.artwork.has_transparency", "warning", "has transparency", "color_mode", c("color_mode")),
        finding(c("dpi_x").isNull(), "universal.artwork.dpi_not_set", "info", "no resolution set", "dpi_x"),
        finding(c("dpi_x") < 72, "universal.artwork.dpi_too_low", "warning", "under 72 dpi", "dpi_x", c("dpi_x")),
        finding((c("dpi_x") >= 72) & (c("dpi_x") < 300), "universal.artwork.dpi_below_recommended", "info", "under 300 dpi", "dpi_x", c("dpi_x")),
    ])


def text_heavy(pixels: Column) -> Column:
    """Whether an image of (r, g, b) pixels, 0 to 255, is mostly flat black or white with strong contrast."""
    value = lambda p: F.greatest(p["r"], p["g"], p["b"]) / 255.0
    low = lambda p: F.least(p["r"], p["g"], p["b"]) / 255.0
    flat = F.size(F.filter(pixels, lambda p: (F.coalesce(F.try_divide(value(p) - low(p), value(p)), F.lit(0.0)) < 0.15) & ((value(p) < 0.1) | (value(p) > 0.85))))
    n = F.size(pixels)
    grey = lambda p: (p["r"] * 0.299 + p["g"] * 0.587 + p["b"] * 0.114) / 255.0
    total = lambda f: F.aggregate(pixels, F.lit(0.0), lambda s, p: s + f(p))
    mean = F.try_divide(total(grey), n)
    deviation = F.sqrt(F.greatest(F.try_divide(total(lambda p: grey(p) * grey(p)), n) - mean * mean, F.lit(0.0)))
    return F.coalesce((F.try_divide(flat.cast("double"), n) > 0.25) & (deviation > 0.15), F.lit(False))


def missing(releases: DataFrame, media: DataFrame, key: str, rule_id: str, message: str) -> DataFrame:
    """An info finding for each release without a row in media."""
    return releases.join(media.select(key).distinct(), key, "left_anti").select(key, F.lit(rule_id).alias("rule_id"), F.lit("info").alias("severity"), F.lit(message).alias("message"))


def declared_findings(releases: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of what metadata declares alone: artwork_width and artwork_height, and tracks (title, duration_ms); a row a short track."""
    c, tracks = F.col, F.coalesce("tracks", F.array())
    small = (c("artwork_width") > 0) & (c("artwork_height") > 0) & (F.least("artwork_width", "artwork_height") < LEAST_SIDE)
    size = F.concat_ws("x", c("artwork_width").cast("string"), c("artwork_height").cast("string"))
    short = lambda t: finding((t["duration_ms"] > 0) & (t["duration_ms"] < 60_000), "declared.track.short", "warning", F.concat(F.lit('"'), F.coalesce(t["title"], F.lit("Unknown Track")), F.lit('" is under 60 seconds')), "tracks", F.concat(F.floor(t["duration_ms"] / 1000).cast("string"), F.lit("s")))
    found = F.concat(F.array_compact(F.array(finding(small, "declared.artwork.resolution", "critical", "artwork is declared under 3000 pixels", "artwork_width", size))), F.array_compact(F.transform(tracks, short)))
    return releases.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")
