"""Predicates and coercions of schemaless values: meaningful, ids, urls, times, bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Numbers below it are seconds, others milliseconds.
SECONDS_BELOW = 100_000_000_000


def meaningful(x: Column) -> Column:
    """Neither null nor blank. Zero and false are meaningful."""
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def meaningful_json(x: Column) -> Column:
    """As `meaningful` for a JSON text; empty lists and objects aren't, and neither is null."""
    return meaningful(x) & ~F.trim(x).isin("null", "[]", "{}", '""')


def first_meaningful(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def normal_id(*columns: Column) -> Column:
    return F.lower(first_meaningful(*columns))


def is_uuid(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike(UUID), F.lit(False))


def safe_https(x: Column, max_length: int = 2048) -> Column:
    """Whether a url is https, has a host and no user info, and isn't too long."""
    return F.coalesce(x.rlike("^https://[^/?#@]+([/?#].*)?$") & (F.length(x) <= max_length), F.lit(False))


def any_time(x: Column, now: Column) -> Column:
    """Milliseconds of a number of seconds or milliseconds, or of ISO text; null before 2000 or over a day after now."""
    number = x.try_cast("double")
    ms = F.when(number.isNotNull(), F.when(number < SECONDS_BELOW, number * 1000).otherwise(number).cast("bigint"))
    ms = F.coalesce(ms, F.unix_millis(F.try_to_timestamp(x)))
    return F.when((ms >= 946684800000) & (ms <= F.unix_millis(now) + 86_400_000), ms)


def mask(*flags: Column) -> Column:
    """Bit i is set where flag i holds."""
    total = F.lit(0)
    for i, flag in enumerate(flags):
        total = total + F.when(flag, 1 << i).otherwise(0)
    return total
