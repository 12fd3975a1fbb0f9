"""Token totals by day, model, project and session.

Every function takes the events table and the sources dimension (kind, provider) and returns a lazy
DataFrame: one scan with the time range pushed down, a broadcast join and one aggregation. All but the sessions can also be
taken from the store's daily totals, which have a column events_count, instead of the events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_label, in_window
from ..schemas import TOKEN_COLUMNS

ALL = "all"
#: A project parameter that matches nothing.
NO_PROJECT = "__none__"
#: Dimensions that the optimizer takes to be at most so large are broadcast; others are left to it.
BROADCAST_BYTES = 10 << 20
SESSIONS_DEFAULT, SESSIONS_MAX = 25, 500


def is_small(dimension: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the estimated size of the dimension's plan is within ``limit`` bytes. No job is run."""
    return int(str(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def small(dimension: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The dimension with a broadcast hint, if :func:`is_small`; what turns out small only at run time is broadcast by
    adaptive execution."""
    return F.broadcast(dimension) if is_small(dimension, limit) else dimension


def total_tokens() -> Column:
    """Sum of the five token classes."""
    total = F.col(TOKEN_COLUMNS[0])
    for name in TOKEN_COLUMNS[1:]:
        total = total + F.col(name)
    return total


def parse_projects(parameter: str | None) -> list[str] | None:
    """None: all projects; a list: these; the empty list: no project at all.

    Absent, empty, ``all`` and lists without an entry mean all; ``__none__`` matches nothing."""
    if not parameter or parameter == ALL:
        return None
    if parameter == NO_PROJECT:
        return []
    return [p for p in parameter.split(",") if p] or None


def encode_projects(projects: list[str] | None) -> str | None:
    """The parameter that :func:`parse_projects` reads."""
    return None if projects is None else ",".join(projects) if projects else NO_PROJECT


def clamp_sessions(limit: int | None) -> int:
    """25 by default, 500 at most; limits below 1 raise ValueError."""
    if limit is None:
        return SESSIONS_DEFAULT
    if limit <= 0:
        raise ValueError("limit must be positive")
    return min(limit, SESSIONS_MAX)


def usage(events: DataFrame, sources: DataFrame, start, end, provider: str = ALL, projects: list[str] | None = None) -> DataFrame:
    """Events of a window (both days inclusive) with their provider, restricted by provider and projects."""
    rows = events.where(in_window(F.col("occurred_at"), start, end))
    if projects is not None:
        rows = rows.where(F.col("project_id").isin(*projects) if projects else F.lit(False))
    kinds = sources.select(F.col("kind").alias("source"), "provider")
    if provider != ALL:
        kinds = kinds.where(F.col("provider") == provider)
    return rows.join(small(kinds), "source")


def events_count(rows: DataFrame, where: Column | None = None) -> Column:
    """The number of events (for which ``where`` holds) behind ``rows``, which are events or daily totals of events."""
    one = F.col("events_count") if "events_count" in rows.columns else F.lit(1)
    return F.coalesce(F.sum(one if where is None else F.when(where, one)), F.lit(0)).cast("bigint")


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOKEN_COLUMNS]


def daily_usage(events: DataFrame, sources: DataFrame, start, end, provider: str = ALL) -> DataFrame:
    """date, model, total_tokens."""
    rows = usage(events, sources, start, end, provider)
    return rows.groupBy(bucket_label(F.col("occurred_at"), "day").alias("date"), "model").agg(F.sum(total_tokens()).alias("total_tokens")).orderBy("date", "model")


def daily_usage_breakdown(events, sources, start, end, provider: str = ALL, projects: list[str] | None = None, granularity: str = "day") -> DataFrame:
    """bucket, model and the five token sums."""
    rows = usage(events, sources, start, end, provider, projects)
    return rows.groupBy(bucket_label(F.col("occurred_at"), granularity).alias("bucket"), "model").agg(*_sums()).orderBy("bucket", "model")


def list_models_in_window(events, sources, start, end, provider: str = ALL) -> DataFrame:
    """model, total_tokens of the models with tokens in the window, whatever the project."""
    rows = usage(events, sources, start, end, provider).groupBy("model").agg(F.sum(total_tokens()).alias("total_tokens"))
    return rows.where("total_tokens > 0").orderBy(F.desc("total_tokens"), "model")


def list_projects_with_totals(events, sources, start, end, provider: str = ALL) -> DataFrame:
    """project_id, events_count, total_tokens; ties go by project."""
    rows = usage(events, sources, start, end, provider).where(F.col("project_id").isNotNull())
    found = rows.groupBy("project_id").agg(events_count(rows).alias("events_count"), F.sum(total_tokens()).alias("total_tokens"))
    return found.orderBy(F.desc("total_tokens"), "project_id")


def usage_by_model(events, sources, start, end, provider: str = ALL) -> DataFrame:
    """model, events_count and the five token sums, models without tokens included; ties go by model."""
    rows = usage(events, sources, start, end, provider)
    found = rows.groupBy("model").agg(events_count(rows).alias("events_count"), *_sums())
    return found.orderBy(F.desc(total_tokens()), "model")


def _sessions(events: DataFrame) -> DataFrame:
    return events.where(F.col("session_id").isNotNull()).groupBy("session_id", "project_id").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"),
        F.count(F.lit(1)).alias("events_count"), F.sum(total_tokens()).alias("total_tokens"),
    )


def _last_ended(sessions: DataFrame, limit: int) -> DataFrame:
    return sessions.orderBy(F.desc("ended_at"), "session_id", F.asc_nulls_first("project_id")).limit(limit)


def recent_sessions(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The sessions (by session and project) that ended last; ties go by session, then project."""
    return _last_ended(_sessions(events), clamp_sessions(limit))


def recent_sessions_by_day(events: DataFrame, days: DataFrame, limit: int | None = None) -> DataFrame:
    """:func:`recent_sessions` of a ledger that is partitioned by event_date; ``days`` (occurred_at) are those with events.

    The latest days are read, twice as many each time, until they hold as many sessions as wanted: no other session ended later.
    Only the sessions found, of which there are SESSIONS_MAX at most, are then summed up over all days, without a shuffle of others."""
    wanted, keys = clamp_sessions(limit), ["session_id", "project_id"]
    first, last = days.agg(F.to_date(F.min("occurred_at")), F.to_date(F.max("occurred_at"))).first()
    rows, span = events.where(F.col("session_id").isNotNull()), 1
    if last is None:
        return recent_sessions(events, limit)
    while True:
        latest = rows.where(F.col("event_date") >= F.lit(last - dt.timedelta(days=span - 1)))
        if (last - first).days < span or latest.select(*keys).distinct().limit(wanted).count() >= wanted:
            break
        span *= 2
    ended = latest.groupBy(*keys).agg(F.max("occurred_at").alias("ended_at"))
    chosen = F.broadcast(_last_ended(ended, wanted).select(*[F.col(k).alias(f"_{k}") for k in keys]))
    same = (F.col("session_id") == F.col("_session_id")) & F.col("project_id").eqNullSafe(F.col("_project_id"))
    return _last_ended(_sessions(rows.join(chosen, same, "left_semi")), wanted)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(events_count(events).alias("events_count"))


def source_kinds(sources: DataFrame) -> DataFrame:
    return sources.select("kind").orderBy("kind")


def health_summary(events: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: events_count and the providers, sorted."""
    providers = sources.agg(F.array_sort(F.collect_set("provider")).alias("providers"))
    return count_events(events).join(F.broadcast(providers))
