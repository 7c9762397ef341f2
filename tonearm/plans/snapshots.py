"""Stored results with an end: a query's rows kept under its name and parameters until they expire, and share links on the same store.

A snapshot is a folder that names when it was made and when it ends; Spark's commit marks it whole, so a reader sees it all or not at all, and a
newer one takes its place without touching it. Times are given by a clock, in seconds.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HOUR, WEEK = 3600, 7 * 24 * 3600
NAME = re.compile(r"made=(\d+)-until=(\d+)-\w+$")


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def key(self, name: str, params: dict) -> str:
        return f"{name}-{hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]}"

    def _found(self, key: str) -> list[tuple[int, int, str]]:
        """(made, until, path) of the whole snapshots of a key, newest first, in milliseconds."""
        fs, p = self._fs(f"{self.folder}/{key}")
        if not fs.exists(p):
            return []
        out = []
        for s in fs.listStatus(p):
            if m := NAME.search(s.getPath().getName()):
                path = s.getPath().toString()
                if fs.exists(self._fs(f"{path}/_SUCCESS")[1]):
                    out.append((int(m[1]), int(m[2]), path))
        return sorted(out, reverse=True)

    def put(self, key: str, rows: DataFrame, seconds: int) -> DataFrame:
        now = round(self.clock() * 1000)
        path = f"{self.folder}/{key}/made={now}-until={now + seconds * 1000}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def get(self, key: str) -> DataFrame | None:
        """The newest snapshot that hasn't ended."""
        now = self.clock() * 1000
        live = next((path for _, until, path in self._found(key) if until > now), None)
        return self.spark.read.parquet(live) if live else None

    def read(self, name: str, params: dict, make: Callable[[], DataFrame], seconds: int = HOUR, refresh: bool = False) -> DataFrame:
        """The kept rows of a query, or what make() gives, kept from now on; refresh makes them anew."""
        key = self.key(name, params)
        kept = None if refresh else self.get(key)
        return self.put(key, make(), seconds) if kept is None else kept

    def share(self, rows: DataFrame, seconds: int = WEEK) -> str:
        """A token under which these rows can be read until they expire."""
        token = uuid.uuid4().hex
        self.put(f"share-{token}", rows, seconds)
        return token

    def shared(self, token: str) -> DataFrame | None:
        return self.get(f"share-{token}") if re.fullmatch("[0-9a-f]{32}", token) else None

    def purge(self, key: str, grace: int = HOUR) -> int:
        """Deletes what ended `grace` seconds ago or more, and older snapshots than the newest live one; readers of those have had that long. Returns how many."""
        now, gone, newest = self.clock() * 1000, 0, True
        for made, until, path in self._found(key):
            if until <= now - grace * 1000 or (not newest and made <= now - grace * 1000):
                fs, p = self._fs(path)
                gone += bool(fs.delete(p, True))
            newest &= until <= now
        return gone
