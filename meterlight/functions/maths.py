"""Arithmetic of cost and impact, as column expressions. All floating-point, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in an average month, the base of subscription pro-rating.
DAYS_PER_MONTH = 30.4375
#: Share of the input price that a cache read saves.
CACHE_SAVING = 0.9
DAY_MS = 86_400_000


def billable_multipliers(input_usd: Column, output_usd: Column, cache_read_usd: Column, write_5m: Column, write_1h: Column) -> list[Column]:
    """Weights of the five token classes relative to input tokens."""
    return [F.lit(1.0), F.try_divide(output_usd, input_usd), F.try_divide(cache_read_usd, input_usd), write_5m, write_1h]


def weighted_total(tokens: list[Column], weights: list[Column]) -> Column:
    total = F.lit(0.0)
    for count, weight in zip(tokens, weights, strict=True):
        total = total + count * weight
    return total


def billable_tokens(tokens: Column, weight: Column) -> Column:
    """Weighted tokens of one class, truncated to a whole number; negative counts are 0."""
    return F.floor(F.greatest(tokens, F.lit(0)) * weight).cast("bigint")


def billable_usd(billable: Column, input_usd: Column) -> Column:
    return billable * input_usd / 1e6


def energy_wh(tokens: list[Column], wh_per_mtok: list[Column]) -> Column:
    """Null rates count as 0."""
    total = F.lit(0.0)
    for count, rate in zip(tokens, wh_per_mtok, strict=True):
        total = total + count * F.coalesce(rate, F.lit(0.0))
    return total / 1e6


def impact_columns(
    energy: Column, pue: Column, co2e: Column, water: Column, indirect: Column, fallback_pue: float, fallback_wue: float | None
) -> dict[str, Column]:
    """Facility energy (Wh), carbon (g) and water (l) of one row; null where a factor is missing."""
    facility = energy * F.coalesce(pue, F.lit(fallback_pue))
    wue = F.coalesce(water, F.lit(fallback_wue).cast("double"))
    return {
        "energy_wh": energy,
        "facility_wh": facility,
        "co2e_g": facility * co2e,
        "water_l": facility / 1000 * wue,
        "indirect_water_l": facility / 1000 * indirect,
    }


def fallbacks(fallback_pue: float | None, fallback_wue: float | None) -> tuple[float, float | None]:
    """Defaults of a factor file: a PUE of 1 where it gives none; no water figure where it gives none."""
    return (1.0 if fallback_pue is None else fallback_pue), fallback_wue


def combine_uncertainty(a: Column, b: Column) -> Column:
    """Two independent bands in percent, by quadrature."""
    return F.round(F.sqrt(a * a + b * b)).cast("int")


def combine_sum_uncertainty(value_a: Column, pct_a: Column, value_b: Column, pct_b: Column) -> Column:
    """Band of a sum from its parts' bands; the larger of them if the sum is not positive."""
    total = value_a + value_b
    joint = F.round(F.sqrt(F.pow(value_a * pct_a, F.lit(2)) + F.pow(value_b * pct_b, F.lit(2))) / F.nullif(total, F.lit(0.0)))
    return F.when(total <= 0, F.greatest(pct_a, pct_b)).otherwise(joint).cast("int")


def significant_digits(uncertainty_pct: Column) -> Column:
    return F.when(uncertainty_pct < 5, 4).when(uncertainty_pct < 15, 3).otherwise(2)


def round_significant(value: Column, digits: Column) -> Column:
    """Round to significant digits; 0 stays."""
    factor = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.round(value * factor) / factor)


def bracket(value: Column, pct: Column) -> Column:
    """Low and high end of a band; null without one."""
    return F.when(pct > 0, F.struct((value * (1 - pct / 100)).alias("low"), (value * (1 + pct / 100)).alias("high")))


def day_start_ms(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * DAY_MS


def overlap_days(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Days of [start, end] within the window; days end a millisecond before midnight, a null end is open."""
    last = day_start_ms(window_end) + (DAY_MS - 1)
    until = F.least(F.coalesce(day_start_ms(end) + (DAY_MS - 1), last), last)
    return F.greatest(until - F.greatest(day_start_ms(start), day_start_ms(window_start)), F.lit(0)) / DAY_MS


def prorated(monthly: Column, days: Column) -> Column:
    return monthly * days / DAYS_PER_MONTH
