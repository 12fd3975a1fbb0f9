"""Cost of usage at list prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import CACHE_SAVING, billable_multipliers, billable_tokens, billable_usd, weighted_total
from ..schemas import TOKEN_COLUMNS
from .usage import small

BILLABLE_COLUMNS = ["billable_" + c for c in TOKEN_COLUMNS]


def with_prices(rows: DataFrame, pricing: DataFrame) -> DataFrame:
    """Left join with the price list on provider and model; prices are not versioned. Adds the price
    columns, the five multipliers (``mult_*``) and ``priced``."""
    prices = pricing.select(
        "provider", "model", "input_usd_per_mtok", "output_usd_per_mtok", "cache_read_usd_per_mtok",
        *[m.alias("mult_" + c) for c, m in zip(TOKEN_COLUMNS, billable_multipliers(*map(F.col, (
            "input_usd_per_mtok", "output_usd_per_mtok", "cache_read_usd_per_mtok", "cache_write_5m_multiplier", "cache_write_1h_multiplier"))), strict=True)],
        F.lit(True).alias("priced"),
    )
    return rows.join(small(prices), ["provider", "model"], "left").withColumn("priced", F.coalesce("priced", F.lit(False)))


def billable_breakdown(cells: DataFrame, pricing: DataFrame) -> DataFrame:
    """``cells`` (provider, model and token sums) with billable tokens per class, each truncated, and their
    sum; null for models without a price. Truncation is per cell, so it depends on the buckets."""
    priced = with_prices(cells, pricing)
    found = priced.withColumns({b: billable_tokens(F.col(c), F.col("mult_" + c)) for b, c in zip(BILLABLE_COLUMNS, TOKEN_COLUMNS, strict=True)})
    total = F.col(BILLABLE_COLUMNS[0])
    for c in BILLABLE_COLUMNS[1:]:
        total = total + F.col(c)
    return found.withColumn("billable_total", total).drop(*["mult_" + c for c in TOKEN_COLUMNS])


def weighted_tokens(rows: DataFrame, pricing: DataFrame) -> DataFrame:
    """``rows`` with ``weighted_total``: tokens weighted by the multipliers, not truncated."""
    priced = with_prices(rows, pricing)
    total = weighted_total([F.col(c) for c in TOKEN_COLUMNS], [F.col("mult_" + c) for c in TOKEN_COLUMNS])
    return priced.withColumn("weighted_total", total).drop(*["mult_" + c for c in TOKEN_COLUMNS])


def _cell_cost(token_types: list[str] | None):
    chosen = [b for b, c in zip(BILLABLE_COLUMNS, TOKEN_COLUMNS, strict=True) if token_types is None or c in token_types]
    cost = F.lit(0.0)
    for c in chosen:
        cost = cost + billable_usd(F.col(c), F.col("input_usd_per_mtok"))
    return cost


def counterfactual_cost(breakdown: DataFrame, models: list[str] | None = None, token_types: list[str] | None = None) -> DataFrame:
    """cost_usd of the chosen models and token types (None: all) at list prices; unpriced models cost nothing."""
    rows = breakdown if models is None else breakdown.where(F.col("model").isin(*models) if models else F.lit(False))
    return rows.agg(F.coalesce(F.sum(_cell_cost(token_types)), F.lit(0.0)).alias("cost_usd"))


def cost_by_model(breakdown: DataFrame, token_types: list[str] | None = None) -> DataFrame:
    """model, cost_usd and cost_share of the priced models; no share unless the sum is positive."""
    costs = breakdown.where("priced").groupBy("model").agg(F.sum(_cell_cost(token_types)).alias("cost_usd"))
    total = F.sum("cost_usd").over(Window.partitionBy())  # one row per model
    return costs.withColumn("cost_share", F.when(total > 0, F.col("cost_usd") / total))


def cache_stats(breakdown: DataFrame) -> DataFrame:
    """cached_fraction of all prompt tokens, and saved_usd by cache reads (null if nothing is priced)."""
    prompt = F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens"))
    saved = F.sum(F.col("cache_read_tokens") * CACHE_SAVING * F.col("input_usd_per_mtok") / 1e6)
    return breakdown.agg(F.try_divide(F.sum("cache_read_tokens"), prompt).alias("cached_fraction"), saved.alias("saved_usd"))


def models_without_pricing(cells: DataFrame, pricing: DataFrame) -> DataFrame:
    """Models of the cells that have no price, sorted."""
    return cells.select("provider", "model").distinct().join(small(pricing.select("provider", "model")), ["provider", "model"], "left_anti").select("model").distinct().orderBy("model")


def models_without_factors(models: DataFrame, factors: DataFrame) -> DataFrame:
    """Models (provider, model) that have no factor row of any date, sorted."""
    known = small(factors.select("provider", "model").distinct())
    return models.select("provider", "model").distinct().join(known, ["provider", "model"], "left_anti").select("model").distinct().orderBy("model")


def pricing_by_model(models: DataFrame, pricing: DataFrame) -> DataFrame:
    """model, input_usd_per_mtok of the models that have a price."""
    return models.select("provider", "model").distinct().join(small(pricing.select("provider", "model", "input_usd_per_mtok")), ["provider", "model"]).select("model", "input_usd_per_mtok")


def priced_only(rows: DataFrame, pricing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of models with a price, and the list of the models that were dropped."""
    kept = rows.join(small(pricing.select("provider", "model").distinct()), ["provider", "model"], "left_semi")
    return kept, models_without_pricing(rows, pricing)


def visible_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows whose model is in the window's model list."""
    return rows.join(small(models.select("model").distinct()), "model", "left_semi")
