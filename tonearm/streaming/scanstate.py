"""The states of a scan: queued, running, complete or failed; a scan that stays queued or running too long fails.

Events are queue, start, complete, fail and cancel. A move that a scan's state doesn't allow is reported and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import ordered as O

# States by event and state before.
MOVES = {
    ("queue", None): "queued", ("start", "queued"): "running", ("complete", "running"): "complete", ("fail", "running"): "failed",
    ("cancel", "queued"): "failed", ("cancel", "running"): "failed",
}
LIVE = ("queued", "running")
PATIENCE = 15 * 60


class Scans:
    """The fold of one scan's events. seconds: how long a state may last."""

    def __init__(self, at: str = "at", event: str = "event", tie: str = "event_id", seconds: int = PATIENCE):
        self.at, self.event, self.tie, self.seconds = at, event, tie, seconds

    def begin(self) -> dict:
        return {"status": None, "since": None}

    def step(self, state: dict, row: dict) -> list[dict]:
        before = state["status"]
        after = MOVES.get((row[self.event], before))
        if after:
            state |= {"status": after, "since": row[self.at]}
        return [{self.at: row[self.at], self.tie: row[self.tie], "event": row[self.event], "before": before, "status": state["status"], "legal": after is not None}]

    def deadline(self, state: dict) -> int | None:
        return state["since"] + self.seconds * 1_000_000 if state["status"] in LIVE else None

    def expire(self, state: dict, at: int) -> list[dict]:
        before = state["status"]
        state |= {"status": "failed", "since": at}
        return [{self.at: at, self.tie: None, "event": "timeout", "before": before, "status": "failed", "legal": True}]


def schema(events: DataFrame, key: str, at: str, tie: str) -> T.StructType:
    return T.StructType([events.schema[key], T.StructField(at, T.TimestampType()), T.StructField(tie, events.schema[tie].dataType), *[T.StructField(n, T.StringType()) for n in ("event", "before", "status")], T.StructField("legal", T.BooleanType())])


def moves(events: DataFrame, key: str = "scan_id", at: str = "at", event: str = "event", tie: str = "event_id", seconds: int = PATIENCE, late: str = "10 minutes", until: int | None = None) -> DataFrame:
    """Every event of every scan with the state before and after and whether it was allowed, and the timeouts; a stream or a table."""
    fold, out, rows = Scans(at, event, tie, seconds), schema(events, key, at, tie), events.select(key, at, event, tie)
    return O.fold_stream(rows, key, at, tie, fold, out, late) if events.isStreaming else O.fold_batch(rows, key, at, tie, fold, out, until)
