"""Which format a metadata file has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, extension, MIME type; the order is that of preference.
FORMATS = [("xml", ".xml", "application/xml"), ("csv", ".csv", "text/csv"), ("json", ".json", "application/json"), ("bulk", ".txt", "text/plain")]


def detect_format(content: Column, name: Column) -> Column:
    """xml, csv or json: by extension, else by the first 512 bytes, else xml."""
    low = F.lower(F.coalesce(name, F.lit("")))
    head = F.ltrim(F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, 512).cast("string")), "^﻿", ""))
    head = F.regexp_replace(head, r"^\s+", "")
    first = F.element_at(F.split(head, "\n"), 1)
    by_name = F.when(F.endswith(low, F.lit(".csv")), "csv").when(F.endswith(low, F.lit(".json")), "json").when(F.endswith(low, F.lit(".xml")), "xml")
    by_head = F.when(head.rlike(r"^(<\?xml|<ern:|<NewRelease)"), "xml").when(head.rlike(r"^[{\[]"), "json").when(F.contains(first, F.lit(",")) & ~F.startswith(F.trim(first), F.lit("<")), "csv").otherwise("xml")
    return F.coalesce(by_name, by_head)


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """path, content and format of files; the size limit is a filter on the file listing, before any content is read."""
    files = spark.read.format("binaryFile").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select("path", "content", detect_format(F.col("content"), F.col("path")).alias("format"))
