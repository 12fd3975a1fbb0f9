"""Energy, carbon and water of usage, by the factor versions in force on each event's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_label
from ..functions.maths import combine_uncertainty, energy_wh, fallbacks, impact_columns
from ..schemas import TOKEN_COLUMNS
from .asof import asof_join
from .usage import ALL, events_count, usage

WH_COLUMNS = ["wh_per_mtok_input", "wh_per_mtok_output", "wh_per_mtok_cache_read", "wh_per_mtok_cache_write_5m", "wh_per_mtok_cache_write_1h"]


def impact_rows(rows: DataFrame, factors: DataFrame, grids: DataFrame, region: str, fallback_pue: float | None = None, fallback_wue: float | None = None) -> DataFrame:
    """``rows`` (with provider, model, occurred_at and the token columns) with their impact per event.

    A missing model factor counts as zero energy; missing grid factors give nulls, but for the fallbacks."""
    pue, wue = fallbacks(fallback_pue, fallback_wue)
    day = F.to_date("occurred_at")
    factors = factors.select("provider", "model", "valid_from", *WH_COLUMNS, "uncertainty_range_pct")
    with_model = asof_join(rows, factors, ["provider", "model"], day, prefix="ef_")
    grid = grids.where(F.col("region") == region).select(
        F.col("region").alias("_region"), "valid_from", "pue", "co2e_kg_per_kwh", "water_l_per_kwh", "indirect_water_l_per_kwh",
        "co2e_uncertainty_range_pct", "water_uncertainty_range_pct", "indirect_water_uncertainty_range_pct",
    )
    placed = with_model.withColumn("_region", F.lit(region))
    joined = asof_join(placed, grid, ["_region"], day, prefix="gf_").drop("_region")
    energy = energy_wh([F.col(c) for c in TOKEN_COLUMNS], [F.col("ef_" + c) for c in WH_COLUMNS])
    found = impact_columns(
        energy, F.col("gf_pue"), F.col("gf_co2e_kg_per_kwh"), F.col("gf_water_l_per_kwh"), F.col("gf_indirect_water_l_per_kwh"), pue, wue
    )
    return joined.withColumns(found)


def aggregate_impact_by_bucket(
    events: DataFrame, sources: DataFrame, factors: DataFrame, grids: DataFrame, start, end, provider: str = ALL,
    projects: list[str] | None = None, granularity: str = "day", region: str = "us-east-1", fallback_pue: float | None = None, fallback_wue: float | None = None,
) -> DataFrame:
    """Per bucket, provider and model: token sums, impact sums (null if no event contributes), bands and
    counts of events with missing or replaced factors."""
    rows = impact_rows(usage(events, sources, start, end, provider, projects), factors, grids, region, fallback_pue, fallback_wue)
    band = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("int")
    count_if = lambda c: events_count(rows, c).alias
    grouped = rows.groupBy(bucket_label(F.col("occurred_at"), granularity).alias("bucket"), "provider", "model").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLUMNS],
        *[F.sum(c).alias(c) for c in ("energy_wh", "facility_wh", "co2e_g", "water_l", "indirect_water_l")],
        band("ef_uncertainty_range_pct").alias("model_uncertainty_pct"),
        band("gf_co2e_uncertainty_range_pct").alias("_co2e"),
        band("gf_water_uncertainty_range_pct").alias("_water"),
        band("gf_indirect_water_uncertainty_range_pct").alias("_indirect"),
        count_if(~F.col("ef__matched"))("events_missing_env_factor"),
        count_if(F.col("gf_pue").isNull())("events_using_fallback_pue"),
        count_if(F.col("gf_water_l_per_kwh").isNull())("events_using_fallback_wue"),
        events_count(rows).alias("events_count"),
    )
    model = F.col("model_uncertainty_pct")
    return grouped.select(
        "bucket", "provider", "model", *TOKEN_COLUMNS, "energy_wh", "facility_wh", "co2e_g", "water_l", "indirect_water_l", "model_uncertainty_pct",
        combine_uncertainty(model, F.col("_co2e")).alias("co2e_uncertainty_pct"),
        combine_uncertainty(model, F.col("_water")).alias("water_uncertainty_pct"),
        combine_uncertainty(model, F.col("_indirect")).alias("indirect_water_uncertainty_pct"),
        "events_missing_env_factor", "events_using_fallback_pue", "events_using_fallback_wue", "events_count",
    ).orderBy("bucket", "model")


def window_impact(by_bucket: DataFrame) -> DataFrame:
    """One row over all buckets: sums (null if all are null), the largest bands, summed counts."""
    sums = [F.sum(c).alias(c) for c in ("energy_wh", "facility_wh", "co2e_g", "water_l", "indirect_water_l")]
    bands = [F.max(c).alias(c) for c in ("model_uncertainty_pct", "co2e_uncertainty_pct", "water_uncertainty_pct", "indirect_water_uncertainty_pct")]
    counts = [F.sum(c).alias(c) for c in ("events_missing_env_factor", "events_using_fallback_pue", "events_using_fallback_wue", "events_count")]
    return by_bucket.agg(*sums, *bands, *counts)


def compute_impact(rows: DataFrame, fallback_pue: float | None = None, fallback_wue: float | None = None) -> DataFrame:
    """Impact of rows that carry their own factors (columns of both factor tables), with what was used:
    pue_used, wue_used, used_fallback_pue and used_fallback_wue (true only where there is a fallback)."""
    pue, wue = fallbacks(fallback_pue, fallback_wue)
    energy = energy_wh([F.col(c) for c in TOKEN_COLUMNS], [F.col(c) for c in WH_COLUMNS])
    found = impact_columns(energy, F.col("pue"), F.col("co2e_kg_per_kwh"), F.col("water_l_per_kwh"), F.col("indirect_water_l_per_kwh"), pue, wue)
    return rows.withColumns(found).withColumns({
        "pue_used": F.coalesce("pue", F.lit(pue)),
        "wue_used": F.coalesce("water_l_per_kwh", F.lit(wue).cast("double")),
        "used_fallback_pue": F.col("pue").isNull() & F.lit(fallback_pue is not None),
        "used_fallback_wue": F.col("water_l_per_kwh").isNull() & F.lit(fallback_wue is not None),
        "co2e_uncertainty_pct": combine_uncertainty(F.col("uncertainty_range_pct"), F.col("co2e_uncertainty_range_pct")),
        "water_uncertainty_pct": combine_uncertainty(F.col("uncertainty_range_pct"), F.col("water_uncertainty_range_pct")),
    })


def environment_ready(file_status: str, is_placeholder: bool) -> bool:
    """Whether impact figures may be shown."""
    return file_status == "production" and not is_placeholder


def all_null_factor_rows(factors: DataFrame) -> DataFrame:
    """Number of factor rows without any energy rate."""
    none = F.lit(True)
    for c in WH_COLUMNS:
        none = none & F.col(c).isNull()
    return factors.agg(F.count_if(none).alias("all_null_rows"))
