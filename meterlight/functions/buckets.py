"""Calendar buckets, windows and the day arithmetic around them. Everything is UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month")
#: The "all" range preset starts here; the others are days back from today.
ALL_FROM = dt.date(2022, 12, 1)
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "365d": 365}
DEFAULT_WINDOW_DAYS = 30


def granularity_or_day(name: str | None) -> str:
    """Unknown granularities mean day."""
    return name if name in GRANULARITIES else "day"


def bucket_date(ts: Column, granularity: str) -> Column:
    """First day of the bucket: the day, the Monday of the week, or the first of the month."""
    granularity = granularity_or_day(granularity)
    return F.to_date(ts) if granularity == "day" else F.to_date(F.date_trunc(granularity, ts))


def bucket_label(ts: Column, granularity: str) -> Column:
    """The bucket as ``YYYY-MM-DD``."""
    return F.date_format(bucket_date(ts, granularity), "yyyy-MM-dd")


def display_label(bucket: Column, granularity: str) -> Column:
    """``Apr 27`` for days and weeks, ``Apr 2026`` for months."""
    return F.date_format(bucket, "MMM yyyy" if granularity_or_day(granularity) == "month" else "MMM d")


def in_window(ts: Column, start: dt.date | str, end: dt.date | str) -> Column:
    """Both days inclusive, as a half-open range of instants that reaches the Parquet scan."""
    first = dt.date.fromisoformat(str(start))
    after = dt.date.fromisoformat(str(end)) + dt.timedelta(days=1)
    return (ts >= F.lit(dt.datetime.combine(first, dt.time())).cast("timestamp")) & (ts < F.lit(dt.datetime.combine(after, dt.time())).cast("timestamp"))


def resolve_window(start: str | None, end: str | None, today: dt.date) -> tuple[dt.date, dt.date]:
    """Defaults: until today, from 30 days before the end's default. Malformed dates raise ValueError; the
    order of the two is not checked."""
    return (
        dt.date.fromisoformat(start) if start else today - dt.timedelta(days=DEFAULT_WINDOW_DAYS),
        dt.date.fromisoformat(end) if end else today,
    )


def preset_window(preset: str, today: dt.date, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """The window of a range preset: 7d, 30d, 90d, 365d, all or custom."""
    if preset == "custom":
        return start or today, end or today
    return (ALL_FROM if preset == "all" else today - dt.timedelta(days=RANGE_DAYS[preset])), today


def auto_granularity(days: int) -> str:
    """Days up to 120, weeks up to 730, else months."""
    return "day" if days <= 120 else "week" if days <= 730 else "month"


def window_start(today: Column, preset: str | None = None) -> Column:
    """The first day of a preset's window (or of the default window) that ends ``today``."""
    if preset == "all":
        return F.lit(ALL_FROM)
    return F.date_sub(today, RANGE_DAYS[preset] if preset else DEFAULT_WINDOW_DAYS)


def granularity_for(days: Column) -> Column:
    """:func:`auto_granularity` of a column."""
    return F.when(days <= 120, "day").when(days <= 730, "week").otherwise("month")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end, not below 0; 0 where either is null."""
    return F.greatest(F.coalesce(F.datediff(end, start), F.lit(0)), F.lit(0))


def next_bucket(bucket: Column, granularity: str) -> Column:
    granularity = granularity_or_day(granularity)
    return F.add_months(bucket, 1) if granularity == "month" else F.date_add(bucket, 7 if granularity == "week" else 1)


def active_days(bucket: Column, granularity: str, start: dt.date | str, end: dt.date | str) -> Column:
    """Days of the bucket that lie in the window, 1 at least."""
    first = F.greatest(bucket, F.lit(str(start)).cast("date"))
    after = F.least(next_bucket(bucket, granularity), F.date_add(F.lit(str(end)).cast("date"), 1))
    return F.greatest(F.datediff(after, first), F.lit(1))


def enumerate_buckets(spark: SparkSession, start: dt.date | str, end: dt.date | str, granularity: str) -> DataFrame:
    """One row per bucket of the window (column bucket, DATE); none if start lies after end."""
    granularity = granularity_or_day(granularity)
    first, last = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    low = first if granularity == "day" else F.to_date(F.date_trunc(granularity, first))
    step = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity])
    return spark.range(1).where(first <= last).select(F.explode(F.sequence(low, F.greatest(low, last), step)).alias("bucket"))


def relative_time(then: Column, now: Column) -> Column:
    """never, just now, or seconds, minutes, hours, days ago."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)

    def text(value: Column, unit: str) -> Column:
        return F.concat(F.floor(value).cast("string"), F.lit(unit + " ago"))

    return (
        F.when(then.isNull(), "never").when(seconds < 1, "just now").when(seconds < 60, text(seconds, "s"))
        .when(seconds < 3600, text(seconds / 60, "m")).when(seconds < 86400, text(seconds / 3600, "h")).otherwise(text(seconds / 86400, "d"))
    )
