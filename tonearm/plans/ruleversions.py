"""Rules that change while records are judged: an append-only table of versions, and streams that take a new version up between two micro-batches.

Each change adds rows with the next version; a snapshot of a version holds each rule as its last change up to that version left it. A stream
compares the table's version before each micro-batch and compiles a new plan only when it is another; results name the version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rules as R

KINDS = {"active": "boolean"}
SCHEMA = ", ".join(f"`{f.name}` {KINDS.get(f.name, 'string')}" for f in fields(R.Rule)) + ", deleted boolean, place int, version bigint"


class RuleTable:
    """The versions under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # no version yet
            return self.spark.createDataFrame([], SCHEMA)

    def version(self) -> int:
        """The latest version, 0 without any."""
        return self.read().agg(F.max("version")).first()[0] or 0

    def change(self, put: list[R.Rule] = (), delete: list[str] = ()) -> int:
        """Adds or replaces rules and deletes others, as one new version. Writers take turns: as with any file table, two at once need a lock outside."""
        number = self.version() + 1
        rows = [(*asdict(r).values(), False, i, number) for i, r in enumerate(put)]
        rows += [(*asdict(R.Rule(d, None)).values(), True, len(put) + i, number) for i, d in enumerate(delete)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return number

    def snapshot(self, version: int | None = None) -> list[R.Rule]:
        """Rules as they stood at a version (default: the latest), in the order in which they came first. Rules are configuration, so they meet on the driver."""
        rows = self.read() if version is None else self.read().where(F.col("version") <= version)
        of_rule = Window.partitionBy("id")
        last = rows.withColumn("n", F.row_number().over(of_rule.orderBy(F.desc("version"), F.desc("place")))).withColumn("since", F.min(F.struct("version", "place")).over(of_rule))
        kept = last.where("n = 1 and not deleted").orderBy("since").select(*[f.name for f in fields(R.Rule)]).collect()
        return [R.Rule(**r.asDict()) for r in kept]


class Reloading:
    """Judges batches by the table's present version; compiles anew only when it changed."""

    def __init__(self, table: RuleTable, keys: list[str], platforms=R.DEFAULT_PLATFORMS, record_fields: dict[str, str] | None = None):
        self.table, self.keys, self.platforms, self.fields = table, keys, platforms, record_fields
        self.version, self.rules, self.loads = None, [], 0

    def judge(self, records: DataFrame) -> DataFrame:
        now = self.table.version()
        if now != self.version:
            self.version, self.rules, self.loads = now, self.table.snapshot(now), self.loads + 1
        return R.evaluate(records, self.rules, self.keys, self.platforms, self.fields).withColumn("rules_version", F.lit(self.version).cast("long"))


def judge_stream(records: DataFrame, reloading: Reloading, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of records judged batch by batch; sink gets the results and the batch's number, and should write by number, so that a replay replaces itself."""
    return records.writeStream.foreachBatch(lambda batch, number: sink(reloading.judge(batch), number)).option("checkpointLocation", checkpoint)
