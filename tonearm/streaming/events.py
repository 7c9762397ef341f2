"""Structured Streaming over usage events and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import grade, penalty


def usage_windows(events: DataFrame, every: str = "1 day", late: str = "1 hour", keys: tuple[str, ...] = ("endpoint",), at: str = "created_at") -> DataFrame:
    """Calls, errors and latency by window and keys; a watermark bounds the state. Batch input works too."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    w = marked.groupBy(F.window(at, every), *keys).agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("latency_ms").alias("avg_latency"))
    return w.select(F.col("window.start").alias("start"), *keys, "calls", "errors", "avg_latency")


def sliding_windows(events: DataFrame, size: str, step: str, keys: tuple[str, ...], at: str = "ts", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark(at, late) if events.isStreaming else events
    s = marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def rescored(findings: DataFrame) -> DataFrame:
    """Scores that follow late findings: in update mode each new finding renews its scan's row."""
    s = F.col("severity")
    live = ~F.coalesce("resolved", F.lit(False))
    g = findings.groupBy("scan_id").agg(F.count_if(live & (s == "critical")).alias("critical_count"), F.count_if(live & (s == "warning")).alias("warning_count"), F.count_if(live & (s == "info")).alias("info_count"))
    score = penalty(F.col("critical_count"), F.col("warning_count"), F.col("info_count"))
    return g.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def index_batches(releases: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to the catalogue index, partitioned by organisation; a replayed batch overwrites only itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "org_id").parquet(path)

    return releases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def weekly_counters(events: DataFrame, keys: tuple[str, ...], at: str = "created_at", late: str = "1 day") -> DataFrame:
    """Calls by week (from Monday) and keys. A stream in append mode gives each week once, when the watermark has passed it; a table gives all."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    week = F.window(at, "7 days", startTime="4 days")  # the epoch was a Thursday
    return marked.groupBy(week, *keys).agg(F.count("*").alias("calls")).select(F.to_date("window.start").alias("week"), *keys, "calls")


def append_usage(events: DataFrame, path: str, checkpoint: str, at: str = "created_at"):
    """Usage events of a stream appended by day; the file sink's log keeps a replayed batch from appending twice."""
    dated = events.withColumn("day", F.to_date(at))
    return dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
