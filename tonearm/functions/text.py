"""Names, titles and keywords as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that look like Latin ones, and the Latin ones.
LOOKALIKE_FROM = "аеорсхуиӏіАВЕКМНОРСТХοαεν"
LOOKALIKE_TO = "aeopcxyuliABEKMHOPCTXoaev"
LOOKALIKE_DROP = "Ъ"
#: Full-width forms of ASCII, 94 of them.
WIDE_FROM = "".join(chr(0xFF01 + i) for i in range(94))
WIDE_TO = "".join(chr(0x21 + i) for i in range(94))

# Words of functional music, in titles and artist names.
FUNCTIONAL_WORDS = (
    "sleep", "sleeping", "insomnia", "bedtime", "lullaby", "deep sleep", "baby sleep", "sleep music", "sleep sounds",
    "study", "studying", "focus", "concentration", "exam", "study music", "brain music", "focus music", "deep work", "productivity",
    "meditation", "meditate", "mindfulness", "zen", "chakra", "yoga", "healing", "therapy", "spiritual", "mantra", "binaural", "solfeggio",
    "white noise", "brown noise", "pink noise", "rain sounds", "rain music", "ocean waves", "forest sounds", "nature sounds", "thunderstorm",
    "fireplace", "café sounds", "coffee shop", "relaxation", "relax", "calm", "calming", "stress relief", "anxiety relief", "peaceful",
    "serenity", "tranquil", "asmr", "whisper", "tapping", "background music", "work music", "library music", "study lofi", "lofi beats", "chill beats",
)
# Names of generation tools, and phrases.
TOOL_WORDS = (
    "suno", "udio", "amper", "aiva", "mubert", "loudly", "boomy", "soundraw", "beatoven", "ecrett", "soundful", "ai music",
    "ai generated", "ai composed", "artificial intelligence", "generated by", "created by ai",
)
# Fixed value: titles without content.
GENERIC_TITLE = r"(?i)^(track\s*[0-9]+|untitled\s*[0-9]*|new\s+song\s*[0-9]*|demo\s*[0-9]*|recording\s*[0-9]*|test\s+track\s*[0-9]*|[0-9]+|song\s*[0-9]*|audio\s*[0-9]*|instrumental\s*[0-9]+|unknown)$"
# Fixed value: titles that end with a number.
NUMBERED_TITLE = r"^(.+?)\s+[0-9]+\s*$"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which has no built-in; used only on text that isn't ASCII."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_title(c: Column) -> Column:
    """Composed (NFC) lower case, one blank between words. Only text that isn't ASCII goes to Python."""
    composed = F.coalesce(nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c, F.lit(""))
    return F.regexp_replace(F.trim(F.lower(composed)), r"\s+", " ")


def normalize_artist(c: Column) -> Column:
    """As titles, with joined names joined by "and" and featured artists gone."""
    s = F.regexp_replace(normalize_title(c), r"\s*&\s*", " and ")
    s = F.regexp_replace(s, r",\s+", " and ")
    return F.trim(F.regexp_replace(s, r"\s+(feat\.|ft\.|featuring)\s+.*$", ""))


def fold_lookalikes(c: Column) -> Column:
    """Look-alike characters as the Latin ones they resemble."""
    return F.translate(c, LOOKALIKE_FROM + WIDE_FROM + LOOKALIKE_DROP, LOOKALIKE_TO + WIDE_TO)


def has_lookalikes(c: Column) -> Column:
    return fold_lookalikes(c) != c


def words_found(c: Column, words) -> Column:
    """Those of the words that a text contains, sorted."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(w) for w in sorted(words)]), lambda w: F.contains(low, w))


def has_word(c: Column, words) -> Column:
    """Whether a text contains one of the words; those that hold another of them add nothing."""
    least = [w for w in sorted(words) if not any(v != w and v in w for v in words)]
    return F.lower(c).rlike("|".join(re.escape(w) for w in least))


def safe_file_name(c: Column) -> Column:
    """The last part of a path with other characters than letters, digits, dots and dashes as underscores; "upload" if none is left."""
    name = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[^\p{L}\p{N}_.\-]", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", "upload").otherwise(name)


def safe_title(c: Column) -> Column:
    """A title as part of a file name: at most 60 characters."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("scan")), r"[^\p{L}\p{N}_\-]", "_"), 1, 60)


def url_extension(c: Column) -> Column:
    """Extension of a URL's file with its dot, at most 6 characters; ".bin" without one."""
    name = F.regexp_replace(F.rtrim(F.element_at(F.split(c, r"\?"), 1), F.lit("/")), r"^.*/", "")
    found = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when((found != "") & (F.length(found) <= 6), found).otherwise(".bin")


def data_url_bytes(c: Column) -> Column:
    """Bytes of a base64 data: URL; null for anything else."""
    body = F.regexp_extract(c, r"^data:[^,]*;base64,(.*)$", 1)
    return F.when(body != "", F.try_to_binary(body, F.lit("base64")))


def rule_label(c: Column) -> Column:
    """The last part of a rule id in title case."""
    return F.initcap(F.replace(F.element_at(F.split(c, r"\."), -1), F.lit("_"), F.lit(" ")))


def generic_title(c: Column) -> Column:
    return F.trim(c).rlike(GENERIC_TITLE)


def title_prefix(c: Column) -> Column:
    """What stands before a number at the end of a title, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(c), NUMBERED_TITLE, 1)), F.lit(""))


def formulaic_titles(titles: Column) -> Column:
    """Titles of an array that share their prefix before a number with another."""
    prefixes = F.filter(F.transform(titles, title_prefix), lambda p: p.isNotNull())
    # as the one element of an array the prefixes are made once, not again for each title
    return F.element_at(F.transform(F.array(prefixes), lambda ps: F.size(F.filter(ps, lambda p: F.size(F.filter(ps, lambda q: q == p)) >= 2))), 1)
