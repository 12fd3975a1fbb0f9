"""Schemas of the usage-analytics tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, DATE, TS, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType()  # noqa: E741

#: The five token classes, in their fixed order.
TOKEN_COLUMNS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens"]

EVENTS = _schema(
    ("source", S), ("occurred_at", TS), ("model", S), *((c, L) for c in TOKEN_COLUMNS),
    ("request_id", S), ("content_hash", S), ("session_id", S), ("project_id", S), ("workspace_id", S), ("api_key_id", S), ("raw", S),
)
#: Token sums of a day (occurred_at is its midnight), source, model and project.
TOTALS = _schema(("source", S), ("occurred_at", TS), ("model", S), ("project_id", S), *((c, L) for c in TOKEN_COLUMNS), ("events_count", L))
SOURCES = _schema(("kind", S), ("display_name", S), ("enabled", B), ("provider", S))
PRICING = _schema(
    ("provider", S), ("model", S), ("display_name", S), ("valid_from", DATE),
    ("input_usd_per_mtok", D), ("output_usd_per_mtok", D), ("cache_read_usd_per_mtok", D),
    ("cache_write_5m_multiplier", D), ("cache_write_1h_multiplier", D), ("source_url", S), ("source_accessed_at", DATE), ("notes", S),
)
ENV_FACTORS = _schema(
    ("provider", S), ("model", S), ("valid_from", DATE), ("valid_to", DATE),
    ("wh_per_mtok_input", D), ("wh_per_mtok_output", D), ("wh_per_mtok_cache_read", D), ("wh_per_mtok_cache_write_5m", D), ("wh_per_mtok_cache_write_1h", D),
    ("uncertainty_range_pct", I), ("confidence", S), ("source_doc", S), ("notes", S),
)
GRID_FACTORS = _schema(
    ("region", S), ("valid_from", DATE), ("valid_to", DATE),
    ("co2e_kg_per_kwh", D), ("water_l_per_kwh", D), ("indirect_water_l_per_kwh", D), ("pue", D),
    ("co2e_uncertainty_range_pct", I), ("water_uncertainty_range_pct", I), ("indirect_water_uncertainty_range_pct", I),
    ("egrid_subregion", S), ("egrid_subregion_full_name", S), ("source_url", S), ("source_accessed_at", DATE),
)
SUBSCRIPTIONS = _schema(("id", L), ("plan_name", S), ("monthly_usd", D), ("started_at", DATE), ("ended_at", DATE))
CHARGES = _schema(
    ("source", S), ("occurred_at", DATE), ("amount_usd", D), ("description", S), ("category", S), ("external_id", S), ("raw", S),
)
FILE_STATE = _schema(("source", S), ("file_path", S), ("mtime_ns", L), ("len", L), ("last_scanned_at", TS))
