"""Folds over a key's events in the order of their time, the same over a stream and over a table.

A fold is an object with begin() -> state (JSON values), step(state, row) -> output rows, deadline(state) -> microseconds or None, and
expire(state, at) -> output rows: what happens when nothing came until then. step and expire change the state.

Over a stream, rows wait as state until the watermark passes their time; an event-time timer then folds them in order, so that any
order of arrival within the watermark gives the same rows, and deadlines fall by the event clock, never by the wall clock. Over a
table, a key's rows pass by sorted, as a stream: only its state is held.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def plain(rows: pd.DataFrame, at: str) -> list[dict]:
    """Rows as JSON values, their time in microseconds."""
    out = rows.drop(columns=[at]).astype(object).where(rows.drop(columns=[at]).notna(), None).to_dict("records")
    return [{k: v.item() if hasattr(v, "item") else v for k, v in r.items()} | {at: t} for r, t in zip(out, micros(rows[at]))]


def frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names)
    for f in schema:
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = pd.to_datetime(out[f.name], unit="us")
        elif isinstance(f.dataType, (T.LongType, T.IntegerType)):
            out[f.name] = out[f.name].astype("Int64")  # keeps nulls
        else:
            out[f.name] = out[f.name].astype(object).where(out[f.name].notna(), None)
    return out


def due(fold, state: dict, until: int | float) -> list[dict]:
    """What the deadlines up to a time bring."""
    out = []
    while (d := fold.deadline(state)) is not None and d <= until:
        out += fold.expire(state, d)
    return out


def advance(fold, state: dict, row: dict, at: str) -> list[dict]:
    """Deadlines before the row, then the row."""
    return due(fold, state, row[at] - 1) + fold.step(state, row)


class OrderedFold(StatefulProcessor):
    """State of a key: the fold's own, and the rows that wait."""

    def __init__(self, fold, key: str, at: str, tie: str, schema: T.StructType):
        self.fold, self.key, self.at, self.tie, self.schema = fold, key, at, tie, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.waiting = handle.getListState("waiting", "ms bigint, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r for pdf in rows for r in plain(pdf, self.at)]
        ms = [math.ceil(r[self.at] / 1000) for r in held]
        self.waiting.appendList([(m, json.dumps(r)) for m, r in zip(ms, held)])
        for m in set(ms):
            self.handle.registerTimer(m)
        yield pd.DataFrame(columns=self.schema.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.waiting.get())
        ready = sorted((json.loads(r) for m, r in rows if m <= until), key=lambda r: (r[self.at], r[self.tie]))
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.begin()
        out = []
        for r in ready:
            out += advance(self.fold, state, r, self.at)
        out += due(self.fold, state, until * 1000)
        if ready:
            left = [(m, r) for m, r in rows if m > until]
            self.waiting.put(left) if left else self.waiting.clear()
        if (d := self.fold.deadline(state)) is not None:
            self.handle.registerTimer(math.ceil(d / 1000))
        if state == self.fold.begin():
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        yield frame([{self.key: key[0]} | r for r in out], self.schema)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, key: str, at: str, tie: str, fold, schema: T.StructType, late: str = "10 minutes") -> DataFrame:
    """The fold over a stream in append mode; rows later than `late` are dropped. Rows without a time are left out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    return marked.groupBy(key).transformWithStateInPandas(OrderedFold(fold, key, at, tie, schema), schema, "Append", "EventTime")


def fold_batch(events: DataFrame, key: str, at: str, tie: str, fold, schema: T.StructType, until: int | None = None) -> DataFrame:
    """The same over a table; `until` (microseconds): deadlines up to it fall. A null key is a key; rows without a time are left out."""
    ordered = events.where(F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at, tie)

    def run(batches):
        here, state = None, None
        end = lambda: [{key: here[0]} | r for r in due(fold, state, until)] if state is not None and until is not None else []
        for pdf in batches:
            out = []
            for k, r in zip(pdf[key].astype(object).where(pdf[key].notna(), None), plain(pdf, at)):
                if here is None or here[0] != k:
                    out += end()
                    here, state = (k,), fold.begin()
                out += [{key: k} | x for x in advance(fold, state, r, at)]
            yield frame(out, schema)
        yield frame(end(), schema)

    return ordered.mapInPandas(run, schema)
