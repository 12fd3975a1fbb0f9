"""Billing charges, subscriptions and net value."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import overlap_days, prorated
from .usage import small


def charges_in_window(charges: DataFrame, start, end, source: str | None = None) -> DataFrame:
    """Charges of a window (both days inclusive), latest first."""
    rows = charges.where(F.col("occurred_at").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.desc("occurred_at"), F.desc("id" if "id" in charges.columns else "external_id"))


def sum_charges_in_window(charges: DataFrame, start, end, source: str | None = None) -> DataFrame:
    """total_usd; refunds count negative, an empty window is 0."""
    return charges_in_window(charges, start, end, source).agg(F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("total_usd"))


def charges_by_kind(charges: DataFrame, start, end) -> DataFrame:
    """subscription_usd and other_usd of a window."""
    subscription = F.col("category") == "subscription"
    zero = F.lit(0.0)
    return charges_in_window(charges, start, end).agg(
        F.coalesce(F.sum(F.when(subscription, F.col("amount_usd"))), zero).alias("subscription_usd"),
        F.coalesce(F.sum(F.when(~subscription, F.col("amount_usd"))), zero).alias("other_usd"),
    )


def imported_subscriptions(charges: DataFrame) -> DataFrame:
    """Subscription charges grouped by amount (to the cent) and description, largest first."""
    rows = charges.where(F.col("category") == "subscription")
    grouped = rows.groupBy(F.round("amount_usd", 2).alias("amount_usd"), F.coalesce("description", F.lit("")).alias("description"))
    found = grouped.agg(F.count(F.lit(1)).alias("n_charges"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.sum(charges["amount_usd"]).alias("total_usd"))
    return found.orderBy(F.desc("amount_usd"), "description")


def conflict_charges(charges: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """id, plan_name, position, external_id: subscription charges that occurred during a subscription, a row for each
    pair. Charges without an external id are left out. Both sides meet by calendar month, so the join has a key."""
    rows = charges.where((F.col("category") == "subscription") & F.col("external_id").isNotNull())
    position = F.col("position") if "position" in charges.columns else F.unix_date("occurred_at").cast("bigint")
    month = lambda day: F.to_date(F.date_trunc("month", day))
    rows = rows.select(position.alias("position"), "external_id", F.col("occurred_at").alias("charged_at"), month("occurred_at").alias("month"))
    last = F.broadcast(rows.agg(F.max("charged_at").alias("last")))  # one row: open subscriptions end there
    terms = subscriptions.select("id", "plan_name", "started_at", "ended_at").join(last).withColumn("until", F.coalesce("ended_at", "last"))
    months = F.sequence(month("started_at"), month("until"), F.expr("interval 1 month"))
    terms = terms.where("started_at <= until").select("id", "plan_name", "started_at", "until", F.explode(months).alias("month"))
    joined = rows.join(terms, "month").where((F.col("started_at") <= F.col("charged_at")) & (F.col("charged_at") <= F.col("until")))
    return joined.select("id", "plan_name", "position", "external_id")


def subscription_conflicts(charges: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions (id, plan_name) during which subscription charges occurred, with the charges' external
    ids in charge order (``position``, else date and id). Subscriptions that would have an empty list are left
    out. Lists are for imports of a billing export; :func:`conflict_charges` has the same as rows."""
    grouped = conflict_charges(charges, subscriptions).groupBy("id", "plan_name")
    found = grouped.agg(F.array_sort(F.collect_list(F.struct("position", "external_id"))).alias("charges"))
    return found.select("id", "plan_name", F.transform("charges", lambda c: c["external_id"]).alias("external_ids"))


def prorated_subscriptions(subscriptions: DataFrame, start, end) -> DataFrame:
    """prorated_usd of each subscription in the window, by days over 30.4375."""
    low, high = (F.lit(str(d)).cast("date") for d in (start, end))
    days = overlap_days(F.col("started_at"), F.col("ended_at"), low, high)
    found = subscriptions.withColumn("overlap_days", days).where("overlap_days > 0")
    return found.withColumn("prorated_usd", prorated(F.col("monthly_usd"), F.col("overlap_days")))


def list_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.orderBy(F.desc("started_at"), F.desc("id"))


def combine_billed(subscription_usd: Column, imported_usd: Column) -> Column:
    """Sum of two figures that may be unknown; null only if both are."""
    both = F.coalesce(subscription_usd, F.lit(0.0)) + F.coalesce(imported_usd, F.lit(0.0))
    return F.when(subscription_usd.isNotNull() | imported_usd.isNotNull(), both)


def net_value(counterfactual_usd: Column, billed_usd: Column) -> Column:
    """What usage would have cost less what was billed; null if either is unknown."""
    return counterfactual_usd - billed_usd


def apply_overrides(charges: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace categories by key: the external id, or ``row:<position>`` where there is none."""
    keyed = charges.withColumn("_key", F.coalesce("external_id", F.concat(F.lit("row:"), F.col("position").cast("string"))))
    by = small(overrides.select(F.col("key").alias("_key"), F.col("category").alias("_override")))
    return keyed.join(by, "_key", "left").withColumn("category", F.coalesce("_override", "category")).drop("_key", "_override")


def validate_subscription(plan_name: str, monthly_usd: float, started_at: str, ended_at: str | None) -> tuple[str, float, dt.date, dt.date | None]:
    """A cleaned subscription, or ValueError."""
    name = plan_name.strip()
    if not name:
        raise ValueError("plan name is empty")
    if not math.isfinite(monthly_usd) or monthly_usd < 0:
        raise ValueError("monthly price must be finite and not negative")
    start = dt.date.fromisoformat(started_at)
    end = dt.date.fromisoformat(ended_at) if ended_at else None
    if end is not None and end < start:
        raise ValueError("the subscription ends before it starts")
    return name, monthly_usd, start, end
