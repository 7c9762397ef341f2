"""Bulk registration and ISRC files: pipe- or comma-separated lines, with or without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I

HEADER = r"(?i)^(ean|barcode|upc|artist|title|release|imprint|label|narm|config|isni|iswc)"
COLUMNS = 11


def numbered_lines(files: DataFrame, header: Column | None = None) -> DataFrame:
    """path, row_number, line and delimiter. files: path, text (whole, as uploads are limited to a few MB).

    Rows count from 1 without the header; blank lines count too. A file's delimiter is the commoner of | and , in its first
    line that isn't blank; | on a tie.
    """
    text = F.regexp_replace("text", "^﻿", "")
    lines = files.select("path", F.split(text, r"\r\n|\n|\r").alias("lines"))
    first = F.element_at(F.filter("lines", lambda x: F.trim(x) != ""), 1)
    comma = F.coalesce(F.regexp_count(first, F.lit(",")) > F.regexp_count(first, F.lit(r"\|")), F.lit(False))
    sep = F.when(comma, ",").otherwise("|")
    cell = F.trim(F.regexp_replace(F.element_at(F.split(F.element_at("lines", 1), r"[|,]"), 1), '^"|"$', ""))
    skip = (header if header is not None else cell.rlike(HEADER) & ~cell.rlike("^[0-9]+$"))
    out = lines.select("path", sep.alias("delimiter"), F.coalesce(skip, F.lit(False)).alias("skip"), F.posexplode("lines").alias("pos", "line"))
    return out.where(~(F.col("skip") & (F.col("pos") == 0))).select("path", (F.col("pos") + F.when(F.col("skip"), 0).otherwise(1)).alias("row_number"), "line", "delimiter")


def fields(lines: DataFrame, n: int) -> DataFrame:
    """Lines with an array of n trimmed cells; quotes are honoured."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    cells = lambda sep: F.from_csv("line", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
    row = F.when(F.col("delimiter") == ",", cells(",")).otherwise(cells("|"))
    return lines.withColumn("__r", row).withColumn("cells", F.array(*[F.trim(F.coalesce(F.col(f"__r.c{i}"), F.lit(""))) for i in range(n)])).drop("__r")


def parse_releases(files: DataFrame) -> DataFrame:
    """Rows of bulk files; rows without an EAN leave but keep their number's place.

    Old files have ISNI and ISWC in columns 8 and 9, told by an eighth cell of 16 digits or T and digits.
    """
    rows = fields(numbered_lines(files), COLUMNS).where(F.element_at("cells", 1) != "")
    c = lambda i: F.element_at("cells", i + 1)
    n = lambda x: F.nullif(x, F.lit(""))
    old = F.regexp_replace(c(7), "[- ]", "").rlike("^[0-9]{16}$") | F.upper(c(7)).rlike("^T-?[0-9][0-9-]*$")
    return rows.select(
        "path", "row_number", c(0).alias("ean"), c(1).alias("artist"), c(2).alias("title"), c(3).alias("release_date_raw"), I.mmddyy(c(3)).alias("release_date"),
        n(c(4)).alias("imprint"), n(c(5)).alias("label"), c(6).alias("narm_config"),
        F.when(~old, n(c(7))).alias("label_abbreviation"), F.when(~old, n(c(8))).alias("country_code"),
        F.when(old, n(c(7))).otherwise(n(c(9))).alias("isni"), F.when(old, n(c(8))).otherwise(n(c(10))).alias("iswc"),
    )


def parse_isrcs(files: DataFrame) -> DataFrame:
    """Rows of ISRC files, 4 to 7 columns; the first line is a header if its first cell is `isrc`."""
    cell = F.lower(F.trim(F.element_at(F.split(F.element_at("lines", 1), r"[|,]"), 1)))
    rows = fields(numbered_lines(files, cell.rlike("^(isrc|code)")), 7).where(F.element_at("cells", 1) != "")
    c = lambda i: F.element_at("cells", i + 1)
    n = lambda x: F.nullif(x, F.lit(""))
    return rows.select("path", "row_number", c(0).alias("isrc"), c(1).alias("artist"), c(2).alias("title"), c(3).alias("release_date_raw"), I.mmddyy(c(3)).alias("release_date"), n(c(4)).alias("label_abbreviation"), n(c(5)).alias("label_name"), n(c(6)).alias("country_code"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


PDF_ROW = r"([0-9]{13})\s*\|\s*([^|\n]*)\|\s*([^|\n]*)\|\s*([0-9]{6})\s*\|\s*([^|\n]*)\|\s*([^|\n]*)\|\s*([0-9]{2})"


def anchored_row(line: Column) -> Column:
    """A line of columns two blanks apart that begins with an EAN, as a delimited row: the first MMDDYY cell is the anchor; before it stand the artist and the pieces of the title."""
    cells = F.filter(F.transform(F.split(F.regexp_extract(line, r"^[0-9]{13}\s*(.*)$", 1), " {2,}"), lambda c: F.trim(c)), lambda c: c != "")
    is_date = lambda c: c.rlike("^(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{2}$")
    at = F.array_position(F.transform(cells, is_date), True)
    before = F.slice(cells, 2, F.greatest(at - 2, F.lit(0)).cast("int"))
    whole = F.when(at > 1, F.concat(F.slice(cells, 1, 1), F.array(F.array_join(before, " ")), F.slice(cells, F.greatest(at, F.lit(1)).cast("int"), F.size(cells)))).otherwise(cells)
    return F.array_join(F.concat(F.array(F.substring(line, 1, 13)), whole), "|")


def rows_of_page_text(pages: DataFrame) -> DataFrame:
    """Registration rows out of a page's extracted text: delimited rows where there are any; a text that is delimited itself as it is; else each line that isn't blank, those that begin with an EAN aligned at their date."""
    hits = F.regexp_extract_all("text", F.lit(PDF_ROW), F.lit(0))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    delimiters = lambda c: F.length(F.regexp_replace(F.coalesce(F.element_at(F.col("lines"), 1), F.lit("")), f"[^{c}]", ""))
    rows = pages.select("path", hits.alias("hits"), lines.alias("lines")).where("size(hits) > 0 or size(lines) > 0")
    delimited = F.when(F.size("hits") > 0, False).otherwise((delimiters("|") >= 3) | (delimiters(",") >= 3))
    aligned = F.transform("lines", lambda x: F.when(x.rlike("^[0-9]{13}"), anchored_row(x)).otherwise(x))
    found = F.when(F.size("hits") > 0, F.col("hits")).when(delimited, F.col("lines")).otherwise(aligned)
    comma = delimited & (delimiters("|") < 3)
    return rows.select("path", F.when(comma, ",").otherwise("|").alias("delimiter"), F.posexplode(found).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("row_number"), "line", "delimiter")
