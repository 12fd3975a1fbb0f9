"""The reports that combine several operators into one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost, impact
from ..operators.usage import ALL, list_models_in_window


def usage_daily(
    events: DataFrame, sources: DataFrame, pricing: DataFrame, factors: DataFrame, grids: DataFrame, start, end, provider: str = ALL,
    projects: list[str] | None = None, granularity: str = "day", region: str = "us-east-1", fallback_pue: float | None = None, fallback_wue: float | None = None,
) -> DataFrame:
    """Per bucket, provider and model: tokens, impact and billable tokens, of the models that have tokens in
    the window whatever the project."""
    rows = impact.aggregate_impact_by_bucket(events, sources, factors, grids, start, end, provider, projects, granularity, region, fallback_pue, fallback_wue)
    models = list_models_in_window(events, sources, start, end, provider)
    return cost.billable_breakdown(cost.visible_models(rows, models), pricing)


def usage_daily_lists(
    events: DataFrame, sources: DataFrame, pricing: DataFrame, factors: DataFrame, start, end, provider: str = ALL, projects: list[str] | None = None
) -> dict[str, DataFrame]:
    """The model lists that go with :func:`usage_daily`."""
    from ..operators.usage import usage

    models = list_models_in_window(events, sources, start, end, provider)
    in_window = usage(events, sources, start, end, provider).select("provider", "model").distinct()
    cells = usage(events, sources, start, end, provider, projects).select("provider", "model").distinct()
    return {
        "models": models,
        "models_without_pricing": cost.models_without_pricing(cells, pricing),
        "models_without_factors": cost.models_without_factors(in_window, factors),
        "pricing_by_model": cost.pricing_by_model(in_window, pricing),
    }


def net_value_report(breakdown: DataFrame, prorated: DataFrame, by_kind: DataFrame) -> DataFrame:
    """One row: counterfactual, subscriptions, imported charges, what was billed and the net value."""
    from ..operators.billing import combine_billed, net_value

    one = cost.counterfactual_cost(breakdown).join(F.broadcast(prorated.agg(F.sum("prorated_usd").alias("subscriptions_usd"))))
    one = one.join(F.broadcast(by_kind.select((F.col("subscription_usd") + F.col("other_usd")).alias("imported_usd"))))
    billed = combine_billed(F.col("subscriptions_usd"), F.col("imported_usd"))
    return one.withColumn("billed_usd", billed).withColumn("net_usd", net_value(F.col("cost_usd"), billed))
