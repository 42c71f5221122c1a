"""Time functions as Catalyst expressions; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 with Z, offset or fractions; null where it can't be parsed."""
    return F.try_to_timestamp(text)


def account_years(created: Column, as_of: Column) -> Column:
    """Whole days of age as years of 365.25 days."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400)
    return days / F.lit(365.25)


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def week_start(ts: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", ts)


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def next_fetch_start(high_water: Column, now: Column) -> Column:
    """Where the next incremental read begins: a second after the newest row, seven days back at most."""
    floor = now - F.expr("INTERVAL 7 DAYS") + F.expr("INTERVAL 5 MINUTES")
    return F.greatest(high_water + F.expr("INTERVAL 1 SECOND"), floor)


def fetch_gap(high_water: Column, now: Column) -> Column:
    """Seconds between the newest row and the next read's start that no read will cover; 0 without a gap, null without rows."""
    return F.when(high_water.isNotNull(), F.unix_timestamp(next_fetch_start(high_water, now)) - F.unix_timestamp(high_water) - 1)


def fetch_end(now: Column) -> Column:
    return now - F.expr("INTERVAL 30 SECONDS")
