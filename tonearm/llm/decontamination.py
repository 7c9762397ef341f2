"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of letters, digits and what isn't ASCII, A-Z lower-cased. A window is SPAN consecutive words of an item, or all
of a shorter one. Of each window the minimum hash of its K-word grams is kept (K words, or the whole of a shorter
window); over a document the minimum of every window's width of consecutive grams. A window that a document
holds has the same grams there, so the same minimum is kept: every shared span of SPAN words shares a fingerprint, none
is missed. Kept hashes are joined; then, in documents that share one, each place of a gram is extended to the windows that keep
it, and their words are compared as text, so no hash decides.

The first pass sends only kept hashes, once a document. Benchmark hashes, and the keys of the documents that share one, are
broadcast up to MOST_BROADCAST rows by count and joined by a shuffle beyond, where Spark's skew join splits a hash that very
many documents hold. Rows are told by 128 bits of hashes of their text, so copies are worked on as one in the grouping steps,
and their results are joined back.

Defined cases: null and empty texts and texts without words have no words and no hits; items without words
match nothing; rows with equal or null ids are rows of their own; an item id that repeats counts once, a null one not at
all (its text hits all the same); one-word items hit wherever their word stands; empty tables give no
hits; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SPAN, K = 10, 4
#: What separates words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_BROADCAST = 1 << 20


def lowered(word: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def spelled(text: str) -> Column:
    """Words of a text in their own case."""
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SEPARATORS), "")


def keys(text: str) -> list[Column]:
    shown = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(i), shown).alias(f"k{i}") for i in (1, 2)]


def _zipped(left: str, right: str, shift: int, f) -> Column:
    """f of left[i] and right[i + shift], as far as right goes."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), f)


def with_grams(frame: DataFrame, most: int) -> DataFrame:
    """Adds g1 .. g<most>: hashes of the runs of as many words from each word on; w are hashes of the words."""
    frame = frame.withColumn("g1", F.col("w"))
    for n in range(2, most + 1):
        frame = frame.withColumn(f"g{n}", _zipped(f"g{n - 1}", "w", n - 1, lambda a, b: F.xxhash64(a, b)))
    return frame


def with_minima(frame: DataFrame, grams: str, width: int, name: str) -> DataFrame:
    """Adds the minimum of every `width` consecutive grams, by doubling."""
    at, have = grams, 1
    while have < width:
        step = min(have, width - have)
        frame = frame.withColumn(f"{name}_{have + step}", _zipped(at, at, step, lambda a, b: F.least(a, b)))
        at, have = f"{name}_{have + step}", have + step
    return frame.withColumn(name, F.col(at))


def shape(n: int) -> tuple[int, int]:
    """Words a gram and grams a window of n words."""
    k = min(K, n)
    return k, n - k + 1


def teller(n: int, span: int):
    """From a gram's hash to the fingerprint, apart for each length of window."""
    return (lambda g: g) if n == span else (lambda g: F.xxhash64(g, F.lit(n)))


def placed(n: int, span: int):
    """Fingerprint and place of each gram."""
    return lambda g, i: F.struct(teller(n, span)(g).alias("print"), i.alias("p"), F.lit(n).alias("n"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, n, words joined by blanks, print, offset of the gram it keeps), and which items hold them (wid, item)."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.transform(spelled(text), lowered).alias("words"))
    rows = rows.withColumn("w", F.transform("words", lambda x: F.xxhash64(x))).withColumn("n", F.least(F.size("words"), F.lit(span))).where("n > 0")
    rows = rows.withColumn("k", F.least(F.lit(K), F.col("n")))
    rows = with_grams(rows, K)
    grams = F.col(f"g{K}")
    for k in range(K - 1, 0, -1):
        grams = F.when(F.col("k") == k, F.col(f"g{k}")).otherwise(grams)
    rows = rows.select("item", "words", "n", grams.alias("g"), (F.col("n") - F.col("k") + 1).alias("width"), F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    rows = rows.withColumn("own", F.slice("g", F.col("at"), F.col("width"))).withColumn("least", F.array_min("own"))
    each = rows.select("item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("window"), F.when(F.col("n") == span, F.col("least")).otherwise(F.xxhash64("least", "n")).alias("print"), (F.array_position("own", F.col("least")) - 1).cast("int").alias("offset"))
    held = C.materialise(each.distinct(), "windows-held")
    known = C.materialise(held.groupBy("window", "n", "print", "offset").agg(F.count("*").alias("items")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    items_of = C.materialise(held.join(known, ["window", "n", "print", "offset"]).where("item is not null").select("wid", "item"), "window-items")
    C.discard(held)
    return known, items_of


def _bounded(rows: DataFrame) -> DataFrame:
    """Rows marked for broadcast if they are few by count."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def matches(docs: DataFrame, known: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """k1, k2 (hashes of the text), start (of words, from 0), n and wid of every window in a document, once each."""
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # span values at most
    if not lengths:
        return known.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("start"), "n", "wid").limit(0)
    most = max(shape(n)[0] for n in lengths)
    hashed = docs.select(*keys(text), spelled(text).alias("x")).withColumn("w", F.transform("x", lambda x: F.xxhash64(lowered(x))))
    found = with_grams(hashed, most)
    kept = []
    for n in lengths:
        k, width = shape(n)
        found = with_minima(found, f"g{k}", width, f"m{n}")
        kept.append(F.col(f"m{n}") if n == span else F.transform(f"m{n}", teller(n, span)))
    one = F.array_distinct(F.concat(*kept) if len(kept) > 1 else kept[0])
    prints = _bounded(C.materialise(known.select("print").distinct(), "prints"))
    shared = C.materialise(found.select("k1", "k2", F.explode(one).alias("print")).join(prints, "print", "left_semi").select("k1", "k2").distinct(), "shared")
    # only documents that share a fingerprint: places of their grams, extended to windows
    near = docs.select(*keys(text), text).join(_bounded(shared), ["k1", "k2"], "left_semi").select("k1", "k2", F.transform(spelled(text), lowered).alias("words"))
    near = with_grams(near.withColumn("w", F.transform("words", lambda x: F.xxhash64(x))), most)
    grams = F.flatten(F.array(*[F.transform(f"g{shape(n)[0]}", placed(n, span)) for n in lengths]))
    places = near.select("k1", "k2", "words", F.explode(grams).alias("g"))
    first = F.greatest(F.col("g.p") - (span - 1), F.lit(0))
    places = places.select("k1", "k2", "g.*", first.alias("first"), F.slice("words", first + 1, 2 * span).alias("context"))
    small = _bounded(known.select("wid", "n", "print", "offset", "window"))
    joined = places.join(small, ["print", "n"]).withColumn("start", F.col("p") - F.col("offset"))
    same = F.array_join(F.slice("context", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.col("n")), " ") == F.col("window")
    hits = joined.where((F.col("start") >= F.col("first")) & same).select("k1", "k2", "start", "n", "wid").distinct()
    out = C.materialise(hits, "window-hits")
    C.discard(shared)
    return out


def spans(hits: DataFrame) -> DataFrame:
    """k1, k2, start, end: the maximal runs of hit words, in words of the document."""
    order = Window.partitionBy("k1", "k2").orderBy("start", "n")
    ends = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", (F.coalesce(ends, F.lit(-1)) < F.col("start")).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end")).drop("run")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end of each run of hit words, sorted) and items (sorted ids as text) of every document."""
    known, items_of = windows(items, item_id, item_text, span)
    hits = matches(docs, known, text, span)
    runs = spans(hits).groupBy("k1", "k2").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("k1", "k2", "wid").distinct().join(items_of, "wid").select("k1", "k2", "item").distinct()
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    facts = _bounded(C.materialise(runs.join(named, ["k1", "k2"], "left"), "contaminated"))
    every = docs.select(F.col(doc_id).alias("doc_id"), *keys(text), F.size(spelled(text)).cast("long").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return every.join(facts, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("spans", "array<struct<start:int,end:int>>").alias("spans"), none("items", "array<string>").alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs, items)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), b AS MATERIALIZED (
    SELECT CAST(item_id AS VARCHAR) AS item, words, least(len(words), 10) AS n FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), w AS MATERIALIZED (
    SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS t, words[i] AS x, CASE WHEN n > 1 THEN words[i + 1] END AS y
    FROM (SELECT item, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM b)
), p AS MATERIALIZED (
    SELECT r, i, x, lead(x) OVER (PARTITION BY r ORDER BY i) AS y FROM (SELECT r, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM d)
), c AS MATERIALIZED (
    SELECT r, i, n, t, item FROM p JOIN w ON p.x = w.x AND (n = 1 OR p.y = w.y)
), h AS MATERIALIZED (
    SELECT DISTINCT r, i, n, item FROM c JOIN d USING (r) WHERE i + n - 1 <= len(words) AND array_to_string(words[i : i + n - 1], ' ') = t
), covered AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS i FROM h) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
