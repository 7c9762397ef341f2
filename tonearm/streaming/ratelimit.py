"""Sliding-log rate limiter: a call is allowed if fewer than its limit of allowed calls lie in the seconds before it.

Refused calls don't count, so each decision depends on those before it and a window count isn't the same. State is
at most `limit` times for a key, and ends by the event clock when the key was idle for the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import ordered as O

SECONDS = 60
# Calls a minute by tier.
LIMITS = {"starter": 5, "pro": 30, "enterprise": 200}
DEFAULT = 5


class Log:
    """The fold of one key's calls; `tier`: the column with its tier, else `limit` holds for all."""

    def __init__(self, at: str, tie: str, limit: int = DEFAULT, seconds: float = SECONDS, tier: str | None = None):
        self.at, self.tie, self.limit, self.window, self.tier = at, tie, limit, int(seconds * 1_000_000), tier

    def begin(self) -> dict:
        return {"log": []}

    def step(self, state: dict, row: dict) -> list[dict]:
        now = row[self.at]
        limit = LIMITS.get(row[self.tier], DEFAULT) if self.tier else self.limit
        log = [t for t in state["log"] if t >= now - self.window]
        allowed = len(log) < limit
        if allowed:
            log.append(now)
        state["log"] = log
        reset = (now if allowed else log[0] if log else now) + self.window
        return [{self.at: now, self.tie: row[self.tie], "allowed": allowed, "remaining": max(limit - len(log), 0) if allowed else 0, "reset": -(-reset // 1_000_000)}]

    def deadline(self, state: dict) -> int | None:
        return state["log"][-1] + self.window + 1 if state["log"] else None

    def expire(self, state: dict, at: int) -> list[dict]:
        state["log"] = []
        return []


def decide(times: list[float], limit: int, seconds: float, held: list[float] = ()) -> tuple[list[bool], list[float]]:
    """The same for one key's times in seconds: whether each is allowed, and the log."""
    fold, state = Log("at", "tie", limit, seconds), {"log": [round(t * 1_000_000) for t in held]}
    allowed = [fold.step(state, {"at": round(t * 1_000_000), "tie": None})[0]["allowed"] for t in times]
    return allowed, [t / 1_000_000 for t in state["log"]]


def _schema(events: DataFrame, key: str, at: str, tie: str) -> T.StructType:
    return T.StructType([events.schema[key], T.StructField(at, T.TimestampType()), events.schema[tie], T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()), T.StructField("reset", T.LongType())])


def limits(events: DataFrame, key: str, at: str, tie: str, limit: int = DEFAULT, seconds: int = SECONDS, tier: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Each call with `allowed`, `remaining` (calls left in the window) and `reset` (epoch second when the window ends); a stream or a table.

    A null key is a key. Calls without a time can't be judged and are left out. Calls of a key are judged by time, then by tie, however late they come within the watermark.
    """
    rows, fold, out = events.select(key, at, tie, *([tier] if tier else [])), Log(at, tie, limit, seconds, tier), _schema(events, key, at, tie)
    return O.fold_stream(rows, key, at, tie, fold, out, late) if events.isStreaming else O.fold_batch(rows, key, at, tie, fold, out)


def limit_batch(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int = SECONDS) -> DataFrame:
    return limits(events, key, at, tie, limit, seconds).select(key, at, tie, "allowed")


def limit_stream(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int = SECONDS, late: str = "10 minutes") -> DataFrame:
    return limits(events, key, at, tie, limit, seconds, late=late).select(key, at, tie, "allowed")
