"""Billing exports (CSV) as charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import categorize

#: Accepted header names per field, in order of preference.
HEADERS = {
    "date": ("date", "created", "created (utc)", "period start", "date paid", "invoice date"),
    "amount": ("amount", "amount paid", "total", "amount due", "subtotal"),
    "currency": ("currency",),
    "description": ("description", "memo", "line items"),
    "external_id": ("id", "invoice id", "charge id", "number", "invoice number"),
}
#: The forms of dates, in order of preference.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy")


class BadCharge(ValueError):
    """A row's date or amount cannot be read; names the row of the file."""


class MissingColumn(ValueError):
    """The file has no date or no amount column."""


def parse_date(text: Column) -> Column:
    """A date in one of the known forms, of the whole text or of what precedes a space or T."""
    tries = [F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in DATE_FORMATS]
    head = F.regexp_extract(F.trim(text), r"^([^ T]+)", 1)
    more = [F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DATE_FORMATS[:3]]
    return F.coalesce(*tries, *more)


def parse_amount(text: Column) -> Column:
    """Currency signs, commas and spaces are dropped; parentheses mean a negative amount."""
    text = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"[$€£¥,\s]", "")
    value = F.when(inner.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), inner.try_cast("double"))
    return F.when(text.rlike(r"^\(.*\)$"), -value).otherwise(value)


def resolve_columns(header: list[str]) -> dict[str, str | None]:
    """The file's column for each field, by exact name after trimming and lower-casing."""
    names = {}
    for column in header:
        names.setdefault(column.strip().lower(), column)
    return {field: next((names[h] for h in candidates if h in names), None) for field, candidates in HEADERS.items()}


def read_charges(spark: SparkSession, path: str, source: str = "stripe_csv", check: bool = True) -> DataFrame:
    """Charges in USD, with ``position`` (row of data, from 0). The first row whose date or amount cannot
    be read makes the whole file fail, whatever its currency; ``check=False`` leaves such rows null."""
    options = {"multiLine": True, "quote": '"', "escape": '"', "inferSchema": False, "mode": "PERMISSIVE"}
    first = spark.read.csv(path, header=False, **options).first()  # as written: Spark renames repeated names
    header = [(c or "").lstrip("﻿") for c in first or ()]
    names = [f"c{i}" for i in range(len(header))]
    table = spark.read.csv(path, header=True, enforceSchema=True, schema=", ".join(f"{c} string" for c in names) or "c0 string", **options)
    found = resolve_columns(header)
    for field in ("date", "amount"):
        if found[field] is None:
            raise MissingColumn(field)
    cell = lambda field: F.coalesce(F.col(f"c{header.index(found[field])}"), F.lit("")) if found[field] else F.lit("")
    rows = table.select(
        F.monotonically_increasing_id().alias("position"),
        F.lit(source).alias("source"),
        parse_date(cell("date")).alias("occurred_at"),
        parse_amount(cell("amount")).alias("amount_usd"),
        F.nullif(F.trim(cell("description")), F.lit("")).alias("description"),
        F.upper(F.trim(cell("currency"))).alias("currency"),
        F.nullif(F.trim(cell("external_id")), F.lit("")).alias("external_id"),
        F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in table.columns]).alias("raw"),
    )
    if check:
        bad = rows.where(F.col("occurred_at").isNull() | F.col("amount_usd").isNull()).agg(F.min("position")).first()[0]
        if bad is not None:
            raise BadCharge(f"row {bad + 2}")
    rows = rows.where(F.col("currency").isin("", "USD"))
    return rows.withColumn("category", categorize(F.col("description"), F.col("amount_usd"))).select(
        "position", "source", "occurred_at", "amount_usd", "description", "category", "external_id", "raw"
    )


def preview(spark: SparkSession, path: str, subscriptions: DataFrame) -> dict:
    """Charges, their total, how many rows were left out for their currency, and conflicting subscriptions. ``path`` is a file,
    or a folder of files that each have the same header."""
    from ..operators.billing import subscription_conflicts

    charges = read_charges(spark, path)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    lines = text.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file").alias("headers"))
    totals = charges.agg(F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("total_usd"), F.count(F.lit(1)).alias("n_charges"))
    skipped = lines.join(F.broadcast(totals)).select("total_usd", "n_charges", F.greatest(F.col("lines") - F.col("headers") - F.col("n_charges"), F.lit(0)).alias("skipped_non_usd_count"))
    return {"charges": charges, "totals": skipped, "conflicts": subscription_conflicts(charges, subscriptions)}
