"""Identifier and date checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EAN13 = "^[0-9]{13}$"
ISRC = "^([A-Z]{2}-[A-Z0-9]{3}-[0-9]{2}-[0-9]{5}|[A-Z]{2}[A-Z0-9]{3}[0-9]{7})$"
ISWC = "^(T-[0-9]{9}-[0-9]|T[0-9]{10})$"
UPC = "^[0-9]{12,13}$"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def ean_check_digit(digits: Column) -> Column:
    """GS1 check digit of the first 12 digits, weights 1 and 3 in turn; null if they aren't digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(digits.rlike("^[0-9]{12}"), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)))


def ean_problem(ean: Column) -> Column:
    """Why an EAN is not valid, or null."""
    return (
        F.when(ean.isNull() | ~ean.rlike("^[0-9]+$"), "not digits")
        .when(F.length(ean) != 13, "not 13 digits")
        .when(ean.rlike("^0+$"), "all zeros")
        .when(F.substring(ean, 13, 1).cast("int") != ean_check_digit(ean), "check digit")
    )


def isrc_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "-", "")


def isrc_valid(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(ISRC), F.lit(False))


def isni_valid(c: Column) -> Column:
    """16 digits after hyphens and blanks go, not all zeros; a check character X is not accepted."""
    bare = F.regexp_replace(c, "[- ]", "")
    return bare.rlike("^[0-9]{16}$") & ~bare.rlike("^0+$")


def iswc_valid(c: Column) -> Column:
    return c.rlike(ISWC)


def release_date(c: Column) -> Column:
    """A date from YYYY-MM-DD (what follows is left out), or from a year alone, its first day; null for anything else."""
    raw = F.trim(c)
    return F.when(F.length(raw) == 4, F.try_to_date(F.concat(raw, F.lit("-01-01")), "yyyy-MM-dd")).otherwise(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))


def mmddyy(c: Column) -> Column:
    """Six digits as a date from 2000 on, or null."""
    c = F.trim(c)
    return F.when(c.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(F.substring(c, 1, 4), F.lit("20"), F.substring(c, 5, 2)), "MMddyyyy"))


def mmss_ms(c: Column) -> Column:
    ok = F.trim(c).rlike("^[0-9]{1,3}:[0-9]{2}$")
    return F.when(ok, (F.split_part(F.trim(c), F.lit(":"), F.lit(1)).cast("long") * 60 + F.split_part(F.trim(c), F.lit(":"), F.lit(2)).cast("long")) * 1000)


def iso_duration_ms(c: Column) -> Column:
    """PT3M45.5S and its like in milliseconds; null where nothing matches."""
    pattern = "^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.][0-9]+)?)S)?)?"
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(c, pattern, n), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(c.rlike("^P.*[0-9]"), F.round((part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)) * 1000).cast("long"))


def country_codes(spark) -> list[str]:
    """ISO 3166 two-letter codes, as the JVM lists them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())
