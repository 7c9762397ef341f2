"""String similarity, and joins by it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import layout as L

#: Names of a task: each has up to some hundred neighbours.
NAMES = 5_000


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two names, lower-cased and trimmed; 0 if either is empty. No built-in has it."""

    def one(x, y):
        x, y = (x or "").lower().strip(), (y or "").lower().strip()
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_names(left: DataFrame, names: DataFrame, key: str, name: str, known: str, pos: str, most: int = 2, length_gap: int = 3) -> DataFrame:
    """For each row of left the first known name (by pos) within `most` edits; rows whose first hit is equal leave."""
    first = first_near(left.select(name), names, name, known, pos, most, length_gap).where("distance > 0")
    return left.select(key, name).join(first, name).select(key, name, known, pos, "distance")


def first_near(left: DataFrame, names: DataFrame, name: str, known: str, pos: str, most: int = 2, length_gap: int = 3) -> DataFrame:
    """For each distinct name of left the first known name (by pos) within `most` edits, equal ones included: name, known, pos, distance.

    Candidates come from an equi-join on deletion neighbourhoods: two strings within k edits share a string that is made by
    deleting at most k characters from each. So no nested-loop join is needed, and the join stays exact; neighbours of
    both sides are shuffled, linear in both. It works on distinct names, so that a frequent one meets once, and for at most two edits
    (more would need neighbourhoods of the third power of a name's length).
    """
    if not 0 <= most <= 2:
        raise ValueError("most must be 0, 1 or 2")

    def neighbours(c):
        n = F.greatest(F.length(c), F.lit(1))
        without = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n))
        once = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), without(c, i).alias("s")))
        out = F.array(c)
        if most > 0:
            out = F.concat(out, F.transform(once, lambda x: x["s"]))
        if most > 1:  # the second place is at or behind the first, so each pair of places comes once
            out = F.concat(out, F.flatten(F.transform(F.filter(once, lambda x: x["i"] < n), lambda x: F.transform(F.sequence(x["i"], n - 1), lambda j: without(x["s"], j)))))
        return out

    hashed = lambda c: F.explode(F.array_distinct(F.transform(neighbours(c), lambda s: F.xxhash64(s))))  # noqa: E731  8 bytes a neighbour; what collides is compared below
    a = L.spread(left.select(name).distinct(), NAMES).withColumn("__n", hashed(F.col(name)))
    b = L.spread(names.groupBy(known).agg(F.min(pos).alias(pos)), NAMES).withColumn("__n", hashed(F.col(known)))
    # merged, since the planner takes the neighbours of known names, some hundred each, for as small as the names, and would send them through the driver to each task
    # a pair that meets often is compared often: that costs less than to shuffle all pairs that meet. Only the smallest pos is kept of each name
    near = lambda df: df.withColumn("distance", F.levenshtein(name, known, most)).where((F.col("distance") >= 0) & (F.abs(F.length(name) - F.length(known)) <= length_gap))
    first = near(a.join(b.hint("merge"), "__n")).groupBy(name).agg(F.min(pos).alias(pos))
    # known names may share a pos: of those that are near the smallest
    found = near(first.join(names.groupBy(known).agg(F.min(pos).alias(pos)), pos))
    return found.groupBy(name).agg(F.min(F.struct(known, pos, "distance")).alias("m")).select(name, "m.*")
