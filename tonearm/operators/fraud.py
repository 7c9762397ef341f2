"""Fraud signals of releases. Input rows: release_id, artist, title, publisher, iswc, tracks, isrc_list, org_id, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import similarity as S
from ..functions import text as X

SIGNAL = "struct<signal_id:string,confidence:string,explanation:string>"
SPREAD_MS, SHORT_SECONDS, MANY_TRACKS = 2000, 60, 20


def signal(condition: Column, signal_id: str, confidence: Column | str, explanation: Column | str) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    explanation = F.lit(explanation) if isinstance(explanation, str) else explanation
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(signal_id).alias("signal_id"), confidence.alias("confidence"), explanation.alias("explanation"))).cast(SIGNAL)


def titles(tracks: Column) -> Column:
    return F.transform(tracks, lambda t: F.coalesce(t["title"], F.lit("")))


def uniform_duration(tracks: Column) -> Column:
    """At least three known durations, all within two seconds."""
    known = F.filter(F.transform(tracks, lambda t: t["duration_ms"]), lambda d: d > 0)
    return (F.size(known) >= 3) & (F.array_max(known) - F.array_min(known) <= SPREAD_MS)


def by_count(n: Column) -> Column:
    return F.when(n <= 2, "low").when(n == 3, "medium").otherwise("high")


def _sum(*flags: Column) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags[1:]), F.coalesce(flags[0], F.lit(False)).cast("int"))


def marks(releases: DataFrame) -> DataFrame:
    """Adds what several signals ask of a release, each made once: __numbered, __uniform, __generic, then __spam and __ai."""
    tracks, n = F.coalesce("tracks", F.array()), F.coalesce(F.size("tracks"), F.lit(0))
    out = releases.withColumns({"__numbered": X.formulaic_titles(titles(tracks)), "__uniform": uniform_duration(tracks), "__generic": F.size(F.filter(titles(tracks), X.generic_title))})
    numbered, uniform = F.col("__numbered"), F.col("__uniform")
    spam = _sum(X.has_word(F.col("artist"), X.FUNCTIONAL_WORDS), X.has_word(F.col("title"), X.FUNCTIONAL_WORDS), n > MANY_TRACKS, uniform, (n >= 3) & (numbered >= F.greatest(F.lit(3.0), n * 0.7)))
    composer = F.exists(tracks, lambda t: ~I.blank(t["composer"]))
    tool = X.has_word(F.concat_ws(" \n ", "publisher", "artist", "title"), X.TOOL_WORDS)
    ai = _sum(~composer & (n > 0), tool, (n >= 3) & (numbered >= n * 0.8), ~composer & I.blank(F.col("iswc")) & (n >= 5), uniform & (n >= 5))
    return out.withColumns({"__spam": spam, "__ai": ai})


def row_signals() -> list[Column]:
    """Signals that one release shows alone, of rows with their marks."""
    tracks, n = F.coalesce("tracks", F.array()), F.coalesce(F.size("tracks"), F.lit(0))
    spam, ai, generic = F.col("__spam"), F.col("__ai"), F.col("__generic")
    short = F.filter(tracks, lambda t: (t["duration_ms"] > 0) & (t["duration_ms"] < SHORT_SECONDS * 1000))
    share = F.try_divide(generic.cast("double"), n)
    return [
        signal(spam >= 2, "fraud.functional_music_spam", by_count(spam), F.concat(spam.cast("string"), F.lit(" marks of functional music"))),
        signal(F.size(short) > 0, "fraud.short_track_duration", "high", F.concat(F.size(short).cast("string"), F.lit(" tracks under 60 seconds"))),
        signal(share >= 0.3, "fraud.generic_track_titles", F.when(share > 0.7, "high").otherwise("medium"), F.concat(generic.cast("string"), F.lit(" generic track titles"))),
        signal(ai >= 2, "fraud.ai_generation_suspected", by_count(ai), F.concat(ai.cast("string"), F.lit(" marks of generated music"))),
    ]


def lone_signals(releases: DataFrame) -> DataFrame:
    return marks(releases).select("release_id", F.explode(F.array_compact(F.array(*row_signals()))).alias("s")).select("release_id", "s.*")


def name_signals(releases: DataFrame, known: DataFrame) -> DataFrame:
    """Artists that look like known ones. known: name, pos."""
    folded = X.strip_marks(X.fold_lookalikes(F.col("artist")))
    rows = releases.select("release_id", "artist", X.has_lookalikes(F.col("artist")).alias("odd"), F.trim(F.lower(F.when(F.col("artist").rlike("[^\\x00-\\x7F]"), folded).otherwise(F.col("artist")))).alias("folded"))
    names = known.select(F.lower(F.trim("name")).alias("known"), "pos")
    near = S.first_near(rows.where("folded <> ''").select("folded"), names, "folded", "known", "pos")
    equal = names.select(F.col("known").alias("folded"), F.lit(True).alias("equal")).distinct()
    # what each name is near to is found once; both signals come out of one explode
    found = rows.join(near, "folded", "left").join(equal, "folded", "left")
    edits, same = F.col("distance"), F.coalesce("equal", F.lit(False))
    signal = lambda condition, name, strong, text: F.when(condition, F.struct(F.lit(name).alias("signal_id"), F.when(strong, "high").otherwise("medium").alias("confidence"), text.alias("explanation")))
    odd = signal(F.col("odd"), "fraud.homoglyph_artist_name", same | F.coalesce((edits > 0) & (edits <= 1), F.lit(False)), F.lit("look-alike characters"))
    similar = signal(F.coalesce(edits > 0, F.lit(False)), "fraud.artist_name_similarity", edits <= 1, F.concat(F.lit("close to "), "known"))
    return found.select("release_id", F.explode(F.array_compact(F.array(odd, similar))).alias("s")).select("release_id", "s.*")


def velocity(releases: DataFrame, key: str, days: int, at: str = "created_at") -> DataFrame:
    """Adds n_recent: rows of the key in the `days` up to each row, itself included.

    Time is cut into blocks of that length; a row counts in its own block and as history of the next, so that a window
    holds two blocks of a key at most, not all rows of a large one. Rows without a time count alone.
    """
    span = days * 86400
    names = releases.columns
    second = F.col(at).cast("timestamp").cast("long")
    dealt = releases.withColumn("__at", second).withColumn("__block", F.floor(F.col("__at") / span)).withColumn("__later", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = dealt.where("__later = 0 or __block is not null").withColumn("__block", F.col("__block") + F.col("__later"))
    w = Window.partitionBy(key, "__block").orderBy("__at").rangeBetween(-span, 0)
    counted = dealt.withColumn("n_recent", F.when(F.col("__at").isNull(), 1).otherwise(F.count("*").over(w)).cast("long"))
    return counted.where("__later = 0").select(*[c for c in names if c != "n_recent"], "n_recent")


def velocity_signals(releases: DataFrame, exempt_orgs: list[str] | None = None) -> DataFrame:
    """Over 5 releases of an artist in 30 days (20: high), over 20 of an organisation in 7 (60: high); exempt organisations have none."""
    if exempt_orgs:
        releases = releases.where(~F.col("org_id").isin(exempt_orgs))
    out = []
    for key, days, some, many, name in (("artist", 30, 5, 20, "artist"), ("org_id", 7, 20, 60, "org")):
        fast = velocity(releases, key, days).where(F.col("n_recent") > some)
        out.append(fast.select("release_id", F.lit(f"fraud.high_release_velocity_{name}").alias("signal_id"), F.when(F.col("n_recent") > many, "high").otherwise("medium").alias("confidence"), F.concat(F.col("n_recent").cast("string"), F.lit(f" releases in {days} days")).alias("explanation")))
    return out[0].unionByName(out[1])


def isrc_conflicts(releases: DataFrame, corpus: DataFrame) -> DataFrame:
    """ISRCs of a release that another release has too. corpus: isrc, release_id."""
    mine = releases.select("release_id", F.explode("isrc_list").alias("i")).select("release_id", I.isrc_key(F.col("i")).alias("isrc")).distinct()
    theirs = corpus.select(I.isrc_key(F.col("isrc")).alias("isrc"), F.col("release_id").alias("other_id")).where("other_id is not null").distinct()
    # the two smallest releases of an ISRC answer for all of its releases, so no pairs are made
    order = Window.partitionBy("isrc").orderBy("other_id")
    two = theirs.withColumn("__rank", F.row_number().over(order)).where("__rank <= 2").groupBy("isrc").agg(F.min("other_id").alias("lo"), F.max("other_id").alias("hi"))
    other = F.when(F.col("release_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return mine.join(two, "isrc").withColumn("other_id", other).where("release_id <> other_id").select("release_id", "isrc", "other_id")


def read_known_names(spark, path: str) -> DataFrame:
    """name and pos of a text file of names, a name a line; blank lines and comments (#) are left out, pos orders the rest."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return lines.select(F.trim("line").alias("name"), "pos").where("name <> '' and not startswith(name, '#')")


def read_definitions(spark, path: str) -> DataFrame:
    """Signal definitions of a YAML file (a list under `signals`): signal_id, severity, resolution, advisory; of repeated ids the last."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()  # a configuration file
    doc = yaml.safe_load(text[0]) if text else {}
    found = {s["id"]: (s["id"], s.get("severity", "warning"), s.get("resolution", "advisory"), bool(s.get("advisory", True))) for s in (doc or {}).get("signals", [])}
    return spark.createDataFrame(list(found.values()), "signal_id string, severity string, resolution string, advisory boolean")


def with_definitions(signals: DataFrame, definitions: DataFrame) -> DataFrame:
    """Severity, resolution and advisory of each signal; unknown ones are advisory warnings. Hard blocks are never low."""
    joined = signals.join(definitions.dropDuplicates(["signal_id"]), "signal_id", "left")
    hard = F.coalesce(F.col("resolution") == "hard_block", F.lit(False))
    return joined.withColumns(
        {"severity": F.coalesce("severity", F.lit("warning")), "resolution": F.coalesce("resolution", F.lit("advisory")), "advisory": F.coalesce("advisory", F.lit(True)), "confidence": F.when(hard & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence"))}
    )
