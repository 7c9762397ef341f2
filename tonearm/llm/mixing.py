"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, where k inverts a Poisson distribution at a uniform number that is
hashed from the seed and the document id. The mean is the source's target repetition rate,
weight * budget / documents of the source, so that expected counts meet the weights without any
coordination between tasks. A mean over MAX_RATE is split into equal parts with hashed numbers of their own,
whose counts are added: sums of independent Poisson counts are Poisson. The copies are then shuffled globally
by a hashed key.

Defined cases: a null source is a source of its own (shown as null; its weight has the key None); with
explicit weights, a source without one has weight 0 and leaves; weights that are null, negative or not
finite raise ValueError, as does a seed that isn't an integer. A null doc_id hashes as the text "null".
Repeated rows with equal ids get equal counts. Empty tables give empty results. Columns of the input are
kept as they are; the names of added columns can be given, and an input column of such a name gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = 17
#: Exponent of the default weights: a source's share goes with its documents to this power.
ALPHA = 0.5
#: Hex digits of the md5 that make the uniform number: 48 bits, exact in a double.
DIGITS = 12
#: Tail digits 48 + log2(mean) bits can't reach: the inversion stops after mean + 12 sqrt(mean) + 24 steps.
#: Means over MAX_RATE, where exp(-mean) nears the least double, are split into equal parts of PART_RATE at most.
MAX_RATE, PART_RATE = 600.0, 500.0
#: Sources whose rates (one short row each) are broadcast.
MOST_SOURCES = 50_000


def uniform(seed: int | Column, *parts: Column) -> Column:
    """A number in (0, 1) from an md5 over the seed (an integer, or a column of seed texts) and the parts."""
    first = seed if isinstance(seed, Column) else F.lit(str(int(seed)))
    text = F.concat_ws(":", first, *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def poisson_count(u: Column, rate: Column) -> Column:
    """The number of k with u > P(X <= k): exact inversion, by one pass over the probabilities."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        over = u > s["cdf"]
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + over.cast("int")).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])).otherwise(0)


def copies(seed: int, doc_id: Column, rate: Column) -> Column:
    """The Poisson count of a document at any rate: one inversion up to MAX_RATE, a sum of independent ones beyond."""
    n = F.ceil(rate / PART_RATE).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda k: poisson_count(uniform(F.concat(F.lit(f"{int(seed)}/"), k.cast("string")), doc_id), rate / n))
    total = F.aggregate(parts, F.lit(0), lambda a, k: a + k)
    return F.when(rate > MAX_RATE, total).otherwise(poisson_count(uniform(seed, doc_id), rate))


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, budget: float | None = None, source: str = "source") -> DataFrame:
    """(source, n_docs, weight, rate): one row a source, by one aggregation with map-side counts."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        for k, w in weights.items():
            if w is None or not math.isfinite(w) or w < 0:
                raise ValueError(f"weight of {k!r} must be a finite number, 0 or more")
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    totals = counts.withColumn("w", weight).agg(F.sum("w").alias("all_w"), F.sum("n_docs").alias("all_docs"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    most = F.lit(float(budget)) if budget is not None else F.col("all_docs").cast("double")
    return (
        counts.withColumn("w", weight)
        .crossJoin(F.broadcast(totals))  # one row
        .select("source", "n_docs", share.alias("weight"), (share * most / F.col("n_docs")).alias("rate"))
    )


def mix_sources(
    docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, budget: float | None = None, seed: int = SEED,
    source: str = "source", doc_id: str = "doc_id", copy_col: str = "copy", key_col: str = "shuffle_key",
) -> DataFrame:
    """Documents repeated to the target weights in a global order that the seed fixes.

    Adds copy_col (from 0) and key_col, by which the result is ordered (then by id and copy). Rates reach
    the rows by a join on the source: up to MOST_SOURCES sources they are broadcast, beyond it the join is
    left to Spark, which splits hot sources. Rows with no copy leave before the sort.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (copy_col.lower(), key_col.lower())])
    rates = source_rates(docs, weights, alpha, budget, source)
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    if rates.count() <= MOST_SOURCES:
        rates = F.broadcast(rates)
    count = copies(seed, F.col(doc_id), F.col("__rate"))
    return (
        docs.join(rates, docs[source].eqNullSafe(F.col("__source")), "inner")
        .withColumn("__n", count)
        .where("__n > 0")
        .withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn(key_col, uniform(seed + 1, F.col(doc_id), F.col(copy_col)))
        .drop("__source", "__rate", "__n")
        .orderBy(key_col, doc_id, copy_col)
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs)


#: The same counts in SQL: probabilities are summed with lgamma instead of a running product.
ORACLE_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n_docs::DOUBLE, {ALPHA}) / sum(pow(n_docs::DOUBLE, {ALPHA})) OVER ()
         * (sum(n_docs) OVER ())::DOUBLE / n_docs AS rate FROM counts),
means AS (
  SELECT source, CASE WHEN rate > {MAX_RATE} THEN ceil(rate / {PART_RATE})::BIGINT ELSE 1 END AS parts, rate / CASE WHEN rate > {MAX_RATE} THEN ceil(rate / {PART_RATE}) ELSE 1 END AS mean
  FROM rates),
d AS (SELECT *, row_number() OVER () AS row FROM documents),
k AS (SELECT row, d.source, doc_id, parts, mean, unnest(range(1, parts + 1)) AS part FROM d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
u AS (
  SELECT row, source, (('0x' || substr(md5('{SEED}' || CASE WHEN parts > 1 THEN '/' || part ELSE '' END || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5)
         / pow(16.0, {DIGITS}) AS u
  FROM k),
ks AS (SELECT unnest(range(0, 1000)) AS k),
cdf AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM means, ks WHERE k <= ceil(mean + 12 * sqrt(mean) + 24)),
n AS (SELECT row, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND u.u > cdf.below)) AS n FROM u GROUP BY row),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n::BIGINT))::INTEGER AS copy FROM d JOIN n USING (row))
SELECT doc_id, text, lang, source, n_chars, copy,
       (('0x' || substr(md5('{SEED + 1}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5)
       / pow(16.0, {DIGITS}) AS shuffle_key
FROM e
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents repeated to the target weights, in shuffled order."""
    inner = C.shielded(docs)
    return mix_sources(inner, copy_col="__copy", key_col="__key").select(*inner.columns).toDF(*docs.columns)
