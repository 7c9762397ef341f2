"""Search for recordings by title and artist over an inverted index, with exact top-k lists and no nested loop.

A text is the set of its words, title and artist words apart. A word weighs more the fewer recordings hold it; a recording scores
by weighted overlap: the weight of shared words over that of all words of either. Only scores of LEAST or more count, so two
texts that reach it share a word among the rarest of each: those before the common words that together weigh less
than LEAST of the text. Just these rare words are indexed and looked up; very common ones never meet, and no pair that counts
is missed. Equal word sets are one entry on both sides, so a song that stands a million times in the index costs one.
Sets are dealt by rare word to tasks, with their words and weights. A task scores the pairs that meet in it and gives the best few of each
asked set, so the pairs, whose number grows with the square of a word's sets, are never shuffled or written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import layout as L
from ..functions import identifiers as I
from . import enrichment as N

LEAST, MOST = 0.3, 5
#: Weights are whole numbers of this unit, so that sums don't depend on order.
UNIT = 1_000_000
#: Recordings a task that compares postings, and postings of a word a side that meet in one tile.
TASK, TILE = 5_000, 8192


def words(title: Column, artist: Column) -> Column:
    """Sorted distinct words, t: before those of the title and a: before those of the artist."""
    part = lambda c, mark: F.transform(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.concat(F.lit(mark), w))
    return F.array_sort(F.array_distinct(F.concat(part(title, "t:"), part(artist, "a:"))))


def _weighed(sets: DataFrame, frequencies: DataFrame, rows: int, least: float, *more: str) -> DataFrame:
    """A row for each word (w) of a set: its weight (u) and whether it is a posting, a rare word that both sides hold.

    Words of no recording weigh as much as those of one.
    """
    each = sets.select("sid", *more, F.explode("words").alias("w")).join(frequencies, "w", "left")
    n = F.coalesce("n", F.lit(1))
    each = each.select("sid", *more, "w", n.alias("n"), F.round(F.log(1 + F.lit(rows) / n) * UNIT).cast("long").alias("u"), F.coalesce("met", F.lit(False)).alias("met"))
    whole = Window.partitionBy("sid")
    rest = whole.orderBy(F.col("n"), F.col("w")).rowsBetween(0, Window.unboundedFollowing)  # from the word on to the commonest
    return each.select("sid", *more, "w", "u", (F.col("met") & (F.sum("u").over(rest) >= F.sum("u").over(whole) * least)).alias("post"))


def _postings(each: DataFrame, *more: str) -> DataFrame:
    """A row for each posting: its word, the set with all its words, their weights (us) and whole weight."""
    sets = each.groupBy("sid", *more).agg(F.collect_list("w").alias("words"), F.collect_list("u").alias("us"), F.sum("u").alias("whole"), F.collect_list(F.when(F.col("post"), F.col("w"))).alias("posts"))
    return sets.select("sid", *more, "words", "us", "whole", F.explode("posts").alias("w"))


def _crowds(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Words of more postings than a tile holds, with their postings a side (null: one tile). Sets that hold a word but don't post it don't count."""
    # by a column that _postings() needs too, so that both read one shuffle
    crowd = lambda each, side, c: each.where("post").groupBy("w").agg(F.count(c).alias(f"n_{side}")).where(F.col(f"n_{side}") > TILE)
    return crowd(asked, "asked", "sid").join(crowd(held, "held", "r0"), "w", "full")


def _tiled(postings: DataFrame, crowds: DataFrame, own: str, other: str, tasks: int) -> DataFrame:
    """Postings dealt by word; a word of many postings is cut into tiles: each part of one side meets each of the other's."""
    cut = lambda c: F.ceil(F.coalesce(F.col(f"n_{c}"), F.lit(1)) / TILE).cast("int")
    part, word = F.pmod(F.xxhash64("sid"), cut(own)).cast("int"), F.xxhash64("w")
    out = postings.join(F.broadcast(crowds), "w", "left")  # a word for each TILE postings at most
    out = out.select("*", part.alias(own), F.explode(F.sequence(F.lit(0), cut(other) - 1)).alias(other))
    out = out.withColumn("deal", F.when((cut("asked") > 1) | (cut("held") > 1), word).otherwise(F.pmod(word, F.lit(tasks)))).drop("n_asked", "n_held")
    return out.repartition(tasks, "deal", "asked", "held")  # as many tasks as the rows ask for: little data, but much work


def _best_met(k: int, least: float):
    """Of two tables of postings, the best k held sets that each asked set meets at a word: q, h, overlap. Pairs stay in the task."""

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        l, r = l.combine_chunks(), r.combine_chunks()  # noqa: E741
        if not l.num_rows or not r.num_rows:
            return _met([], [], [], l, r)
        r = r.take(pc.sort_indices(r.column("w"))).combine_chunks()
        word = pa.concat_arrays([x for t in (l, r) for x in t.column("w").chunks]).dictionary_encode().indices.to_numpy()
        lw, rw = word[: l.num_rows], word[l.num_rows :]
        ends = np.flatnonzero(np.append(rw[1:] != rw[:-1], True)) + 1  # of the runs of a word
        first, last = np.zeros(word.max() + 1, np.int64), np.zeros(word.max() + 1, np.int64)
        first[rw[ends - 1]], last[rw[ends - 1]] = np.append(0, ends[:-1]), ends
        lists = [pa.concat_arrays(t.column("words").chunks) for t in (l, r)]
        codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices.to_numpy()
        l_at, r_at = (np.append(0, np.cumsum(x.value_lengths().to_numpy())) for x in lists)
        l_codes, r_codes = codes[: l_at[-1]], codes[l_at[-1] :]
        us = pa.concat_arrays(l.column("us").chunks).flatten().to_numpy()
        l_whole, r_whole = l.column("whole").to_numpy(), r.column("whole").to_numpy()
        order = np.empty(r.num_rows, np.int64)
        order[pc.sort_indices(r.column("r0")).to_numpy()] = np.arange(r.num_rows)
        weight = np.zeros(codes.max() + 1, np.int64)
        qs, hs, overlaps = [], [], []
        for i in np.flatnonzero(last[lw]).tolist():
            a, b = first[lw[i]], last[lw[i]]
            mine = slice(l_at[i], l_at[i + 1])
            weight[l_codes[mine]] = us[mine]
            shared = np.add.reduceat(weight[r_codes[r_at[a] : r_at[b]]], r_at[a:b] - r_at[a])
            weight[l_codes[mine]] = 0
            overlap = shared / (l_whole[i] + r_whole[a:b] - shared)
            near = np.flatnonzero(overlap >= least)
            if len(near) > k:
                edge = np.partition(overlap[near], -k)[-k]
                near = near[overlap[near] >= edge]
                near = near[np.lexsort((order[a + near], -overlap[near]))[:k]]
            qs.append(np.full(len(near), i))
            hs.append(a + near)
            overlaps.append(overlap[near])
        return _met(qs, hs, overlaps, l, r)

    return run


def _met(qs: list, hs: list, overlaps: list, l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
    rows = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    return pa.table({"q": l.column("sid").take(pa.array(rows(qs, np.int64))), "h": r.column("sid").take(pa.array(rows(hs, np.int64))), "overlap": pa.array(rows(overlaps, np.float64))})


def search(tracks: DataFrame, recordings: DataFrame, key: str, recording: str = "recording_id", k: int = MOST, least: float = LEAST) -> DataFrame:
    """key, pos (from 1), recording and overlap of the best k recordings of each track; ties go to the smaller recording.

    tracks: key, title, artist; recordings: recording, title, artist. Texts without words find nothing and are never found; null keys take no part.
    """
    asked = tracks.where(F.col(key).isNotNull()).select(key, words(F.col("title"), F.col("artist")).alias("words")).where(F.size("words") > 0)
    held = recordings.where(F.col(recording).isNotNull()).select(F.col(recording).alias("r"), words(F.col("title"), F.col("artist")).alias("words")).where(F.size("words") > 0)
    sid = F.substring(F.unhex(F.sha2(F.array_join("words", " "), 256)), 1, 16)
    asked, held = asked.withColumn("sid", sid), held.withColumn("sid", sid)
    asked_sets = asked.groupBy("sid").agg(F.first("words").alias("words"), F.count("*").alias("times"))
    held_sets = held.groupBy("sid").agg(F.first("words").alias("words"), F.count("*").alias("times"), F.min("r").alias("r0"))
    met = asked_sets.select(F.explode("words").alias("w"), "times").groupBy("w").agg((F.sum("times") > 0).alias("met"))
    frequencies = held_sets.select(F.explode("words").alias("w"), "times").groupBy("w").agg(F.sum("times").alias("n")).join(met, "w", "left")
    rows = held.count()
    tasks = L.parts(rows, TASK)
    l_each, r_each = _weighed(asked_sets, frequencies, rows, least), _weighed(held_sets.select("sid", "words", "r0"), frequencies, rows, least, "r0")
    crowds = _crowds(l_each, r_each)
    left = _tiled(_postings(l_each), crowds, "asked", "held", tasks)
    right = _tiled(_postings(r_each, "r0").drop("us"), crowds, "held", "asked", tasks)
    deal = ["deal", "asked", "held"]
    scored = left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(_best_met(k, least), "q binary, h binary, overlap double").distinct()
    # the best k of each word set: of equal sets only the k smallest recordings can count
    of_set = Window.partitionBy("sid").orderBy("r")
    first = held.select("sid", "r").withColumn("n", F.row_number().over(of_set)).where(F.col("n") <= k).select(F.col("sid").alias("h"), "r")
    best = Window.partitionBy("q").orderBy(F.desc("overlap"), "r")
    top = scored.join(first, "h").withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k).select(F.col("q").alias("sid"), "pos", "r", "overlap")
    return asked.select(key, "sid").join(top, "sid").select(key, "pos", F.col("r").alias(recording), "overlap")


def lookup(releases: DataFrame, recordings: DataFrame, key: str, recording: str = "recording_id", k: int = MOST) -> DataFrame:
    """key, via (isrc, search or null), recordings (ids in order, each once) and confidence of each release.

    releases: key, isrc_list, title, artist. Valid ISRCs are looked up first, in their order; only releases none of whose ISRCs is known are searched by title
    and artist, and take the best of the page if it is alike enough. An ISRC of several recordings stands for the smallest.
    """
    r = releases.where(F.col(key).isNotNull())
    known = recordings.where(F.col("isrc").isNotNull()).groupBy(I.isrc_key(F.col("isrc")).alias("code")).agg(F.min(recording).alias("id"))
    codes = r.select(key, F.posexplode("isrc_list").alias("at", "isrc")).where(I.isrc_valid(F.col("isrc"))).select(key, "at", I.isrc_key(F.col("isrc")).alias("code"))
    found = codes.join(known, "code").groupBy(key, "id").agg(F.min("at").alias("at")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    rest = r.join(found, key, "left_anti").where(~I.blank(F.col("title")) & ~I.blank(F.col("artist")))
    page = search(rest, recordings, key, recording, k)
    names = recordings.select(F.col(recording).alias("candidate_id"), F.col("title").alias("c_title"), F.col("artist").alias("c_artist"))
    best = N.best_candidates(rest.select(key, "title", "artist"), page.select(key, "pos", F.col(recording).alias("candidate_id")).join(names, "candidate_id"), key, k)
    out = r.select(key).join(found, key, "left").join(best, key, "left")
    via = F.when(F.col("ids").isNotNull(), "isrc").when(F.col("candidate_id").isNotNull(), "search")
    return out.select(key, via.alias("via"), F.coalesce("ids", F.when(F.col("candidate_id").isNotNull(), F.array("candidate_id"))).alias("recordings"), F.when(F.col("ids").isNull(), F.col("confidence")).alias("confidence"))
