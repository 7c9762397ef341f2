"""Streams over files: each micro-batch is a file, and what comes out must equal the batch result over all files."""

import datetime as dt
import random
import shutil
import time

import pytest
from tonearm.streaming import events as E
from tonearm.streaming import ratelimit as L
from tonearm.streaming import scanstate as M

USAGE = "endpoint string, status_code int, latency_ms long, created_at timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def stream(spark, tmp_path, frames, schema):
    """A stream that reads one file a batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        part = next((tmp_path / f"made{i}").glob("part-*"))
        shutil.copy(part, folder / f"{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.read.schema(schema).parquet(str(folder))


def drain(df, tmp_path, mode, name, rows=None):
    """The memory table of a query that ran over all files, or, where timeouts by the clock keep it running, until it had given that many rows."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck"))
    q = (w if rows else w.trigger(availableNow=True)).start()
    out = df.sparkSession.table(name)
    end = time.time() + 60
    while rows and q.isActive and out.count() < rows and time.time() < end:
        time.sleep(0.2)
    q.stop() if rows else q.awaitTermination(60)
    assert q.exception() is None and not q.isActive
    return out


def test_usage_windows(spark, tmp_path):
    s, b = stream(spark, tmp_path, [[("a", 200, 10, at(1)), ("a", 500, 20, at(50))], [("a", 200, 30, at(2)), ("b", 404, 5, at(200))]], USAGE)
    got = drain(E.usage_windows(s, "1 hour"), tmp_path, "complete", "windows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.usage_windows(b, "1 hour").collect())) == [(at(0), "a", 3, 1, 20.0), (at(180), "b", 1, 1, 5.0)]


def test_late_events_leave_closed_windows_alone(spark, tmp_path):
    # lateness is judged by the watermark before the last batch, so a window stays open for a batch after its end
    s, _ = stream(spark, tmp_path, [[("a", 200, 1, at(0))], [("a", 200, 1, at(600))], [("a", 200, 1, at(601))], [("a", 200, 1, at(1))], [("a", 200, 1, at(1500))]], USAGE)
    got = drain(E.usage_windows(s, "1 hour", "1 hour"), tmp_path, "append", "late")
    assert sorted((r["start"], r["calls"]) for r in got.collect()) == [(at(0), 1), (at(600), 2)]


def test_rescored(spark, tmp_path):
    s, b = stream(spark, tmp_path, [[(1, "critical", False), (2, "info", False)], [(1, "warning", False), (1, "info", True)]], "scan_id int, severity string, resolved boolean")
    got = drain(E.rescored(s), tmp_path, "update", "scores")
    last = {}
    for r in got.collect():  # a memory table keeps each update, in order
        last[r["scan_id"]] = min(r["score"], last.get(r["scan_id"], 101))
    assert last == {r["scan_id"]: r["score"] for r in E.rescored(b).collect()} == {1: 87.0, 2: 99.5}


END = at(10_000)  # rows of another key that push the watermark past all others


@pytest.mark.parametrize("split", [1, 4])
def test_limits_in_any_order_of_arrival(spark, tmp_path, split):
    rows = [(k, at(i / 4), i, "pro" if k == 2 else "starter") for i in range(40) for k in ((1, 2) if i % 3 else (1,))]
    random.Random(split).shuffle(rows)
    cut = -(-len(rows) // split)
    s, b = stream(spark, tmp_path, [rows[i : i + cut] for i in range(0, len(rows), cut)] + [[(9, END, 999, "pro")]], "user_id long, ts timestamp, event_id long, tier string")
    got = drain(L.limits(s, "user_id", "ts", "event_id", seconds=120, tier="tier", late="1 hour"), tmp_path, "append", f"limits{split}")
    want = L.limits(b.where("user_id < 9"), "user_id", "ts", "event_id", seconds=120, tier="tier")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(rows)
    assert got.where("not allowed").count() > 0 and got.where("user_id = 2 and remaining > 20").count() > 0


@pytest.mark.parametrize("split", [1, 5])
def test_scan_moves_in_any_order_of_arrival(spark, tmp_path, split):
    events = ["queue", "start", "complete", "start", "cancel", "fail"]
    rows = [(k, at(i * (2 + k * 3)), events[(i * (k % 2 + 1)) % 6], i) for k in range(6) for i in range(5)]
    random.Random(split).shuffle(rows)
    cut = -(-len(rows) // split)
    s, b = stream(spark, tmp_path, [rows[i : i + cut] for i in range(0, len(rows), cut)] + [[(99, END, "queue", 999)]], "scan_id long, at timestamp, event string, event_id long")
    got = drain(M.moves(s, late="5 hours"), tmp_path, "append", f"moves{split}")
    want = M.moves(b.where("scan_id < 99"), until=1_900_000_000_000_000)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.where("event = 'timeout'").count() > 0 and got.where("not legal").count() > 0


def test_index_batches_replay(spark, tmp_path):
    s, b = stream(spark, tmp_path, [[("e1", 1)], [("e2", 1), ("e3", 2)]], "ean string, org_id int")
    for checkpoint in ("one", "two"):  # the second run replays all batches
        q = E.index_batches(s, str(tmp_path / "index"), str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "index")).select("ean", "org_id").orderBy("ean").collect() == b.orderBy("ean").collect()


def test_sessions(spark):
    rows = [(1, at(0), 1.0), (1, at(20), 2.0), (1, at(60), 4.0), (2, at(5), 8.0)]
    got = E.sessions(spark.createDataFrame(rows, "user_id int, ts timestamp, value double"), "30 minutes", "user_id")
    assert sorted((r["user_id"], r["start"], r["n"], r["total"]) for r in got.collect()) == [(1, at(0), 2, 3.0), (1, at(60), 1, 4.0), (2, at(5), 1, 8.0)]
