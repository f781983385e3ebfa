"""Dates and numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats beyond ISO 8601 that sources use, with and without a zone. Of 05/01/2024 the month comes first, as long as it
# can be one.
ZONED = ["d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z"]
NAIVE = ["M/d/yyyy", "d/M/yyyy", "yyyy/MM/dd", "d MMM yyyy", "d MMM yyyy HH:mm:ss"]
ZONE = r"(?i)\d:\d\d.*([a-z]|[+-]\d\d(:?\d\d)?)$"


def parse_datetime(text: Column) -> Column:
    """A point in time, or null. Without a zone it is UTC, whatever the session's zone is."""
    x = F.nullif(F.trim(text), F.lit(""))
    naive = F.concat(x.try_cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    dayless = F.when(~x.rlike(r"^\d{4}-"), F.regexp_replace(x, "^[A-Za-z]{3}, *", ""))  # a weekday says nothing more
    others = [F.try_to_timestamp(dayless, F.lit(f)) for f in ZONED]
    others += [F.try_to_timestamp(F.concat(dayless, F.lit(" +0000")), F.lit(f"{f} xx")) for f in NAIVE]
    return F.coalesce(F.when(x.rlike(ZONE), x.try_cast("timestamp")).otherwise(naive), *others)


def parse_date(text: Column) -> Column:
    """The day in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(parse_datetime(text)) / 86_400).cast("int"))


def age_days(published: Column, as_of: datetime) -> Column:
    """Days with fractions from the publication to `as_of`; null if undated."""
    return (F.unix_micros(F.lit(as_of)) - F.unix_micros(published)) / F.lit(86_400_000_000.0)


def daily_rate(low: Column, high: Column) -> Column:
    """The upper rate, else the lower; 0 counts as missing."""
    return F.coalesce(F.nullif(high, F.lit(0)), F.nullif(low, F.lit(0)))
