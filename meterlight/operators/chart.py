"""Zero-filled, pivoted series for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import active_days, enumerate_buckets
from ..functions.text import model_family
from ..schemas import TOKEN_COLUMNS
from .usage import small


def _with_calendar(series: DataFrame, columns: list[str], start, end, granularity: str, per_day: bool) -> DataFrame:
    calendar = enumerate_buckets(series.sparkSession, start, end, granularity)
    days = active_days(F.col("bucket"), granularity, start, end) if per_day else F.lit(1)
    filled = small(calendar).join(series, "bucket", "left")
    return filled.select("bucket", *[(F.coalesce(F.col(f"`{c}`"), F.lit(0)) / days).alias(c) for c in columns]).orderBy("bucket")


def stack_by_model(breakdown: DataFrame, models: list[str], start, end, granularity: str, token_types: list[str] | None = None, per_day: bool = True) -> DataFrame:
    """Per bucket one column per model: the chosen token types' sum over the active days, 0 where there is
    no data. ``breakdown``: bucket (label), model, token sums."""
    chosen = TOKEN_COLUMNS if token_types is None else token_types
    value = F.lit(0)
    for c in chosen:
        value = value + F.col(c)
    rows = breakdown.select(F.to_date("bucket").alias("bucket"), "model", value.alias("tokens"))
    return _with_calendar(rows.groupBy("bucket").pivot("model", models).agg(F.sum("tokens")), models, start, end, granularity, per_day)


def stack_by_token_type(breakdown: DataFrame, models: list[str] | None, start, end, granularity: str, per_day: bool = True) -> DataFrame:
    """Per bucket one column per token type, over the chosen models (None: all)."""
    rows = breakdown if models is None else breakdown.where(F.col("model").isin(*models) if models else F.lit(False))
    rows = rows.select(F.to_date("bucket").alias("bucket"), *TOKEN_COLUMNS)
    long = rows.unpivot("bucket", TOKEN_COLUMNS, "token_type", "tokens")
    return _with_calendar(long.groupBy("bucket").pivot("token_type", TOKEN_COLUMNS).agg(F.sum("tokens")), TOKEN_COLUMNS, start, end, granularity, per_day)


def nest_by_bucket(rows: DataFrame, value_columns: list[str]) -> DataFrame:
    """bucket, by_model: a map from ``provider/model`` to the values. The provider is part of the key, so
    models of the same name do not replace each other."""
    key = F.concat_ws("/", "provider", "model")
    entries = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.struct(*value_columns).alias("value"))))
    return rows.groupBy("bucket").agg(F.map_from_entries(entries).alias("by_model")).orderBy("bucket")


def to_json(nested: DataFrame) -> DataFrame:
    return nested.select("bucket", F.to_json("by_model").alias("by_model"))


def palette_index(models: DataFrame) -> DataFrame:
    """``models`` (model, position) with the family and the model's place in it."""
    family = Window.partitionBy("family").orderBy("position")
    return models.withColumn("family", model_family(F.col("model"))).withColumn("index", F.row_number().over(family) - 1)
