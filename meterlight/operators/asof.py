"""As-of joins with versioned dimensions.

A version is in force from the day of its ``valid_from`` until the next version of its key begins. Rows without a
version keep nulls.

A small dimension's versions become intervals (``lead`` over the key) that are broadcast and joined with a range condition. For
any other, :func:`asof_join_by_days` finds the version of each distinct pair of key and day, of which a key has as many
as there are days, however many rows it has; rows then meet their pair's version by equality. Pairs with a thousandth of the rows or more,
of which there are at most a thousand, go by broadcast, so no key and no day brings its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .usage import is_small

#: A pair of key and day with 1/HEAVY of the rows or more is joined by broadcast.
HEAVY = 1000


class DuplicateVersions(ValueError):
    """Two versions of one key begin on the same day."""


def assert_unique_versions(dimension: DataFrame, keys: list[str], valid_from: str = "valid_from") -> None:
    if dimension.groupBy(*keys, valid_from).count().where("count > 1").limit(1).count():
        raise DuplicateVersions(f"{keys} with the same {valid_from}")


def version_intervals(dimension: DataFrame, keys: list[str], valid_from: str = "valid_from") -> DataFrame:
    """The dimension with ``_until``, the day on which the key's next version begins."""
    following = Window.partitionBy(*keys).orderBy(valid_from)
    return dimension.withColumn("_until", F.lead(valid_from).over(following))


def asof_join(
    rows: DataFrame, dimension: DataFrame, keys: list[str], on_date: Column, valid_from: str = "valid_from", respect_valid_to: bool = False, prefix: str = ""
) -> DataFrame:
    """Left as-of join. Dimension columns other than the keys come with ``prefix``; ``_matched`` (with
    the prefix before it) tells whether there was a version. With ``respect_valid_to`` a version also ends
    at its own valid_to (not included)."""
    versions = version_intervals(dimension, keys, valid_from)
    if not is_small(versions):
        return asof_join_by_days(rows, dimension, keys, on_date, valid_from, respect_valid_to, prefix)
    renamed = versions.select(*[F.col(c).alias(f"_d_{c}") for c in versions.columns], F.lit(True).alias("_d__matched"))
    condition = (F.col(f"_d_{valid_from}") <= on_date) & (F.col("_d__until").isNull() | (on_date < F.col("_d__until")))
    for key in keys:
        condition &= F.col(key) == F.col(f"_d_{key}")
    if respect_valid_to:
        condition &= F.col("_d_valid_to").isNull() | (on_date < F.col("_d_valid_to"))
    joined = rows.join(F.broadcast(renamed), condition, "left")
    mine = [F.col(f"_d_{c}").alias(prefix + c) for c in dimension.columns if c not in keys]
    return joined.select(*rows.columns, *mine, F.coalesce(F.col("_d__matched"), F.lit(False)).alias(prefix + "_matched"))


def versions_by_day(pairs: DataFrame, dimension: DataFrame, keys: list[str], valid_from: str = "valid_from", respect_valid_to: bool = False) -> DataFrame:
    """``pairs`` (distinct keys and _day, other columns) with _v, the version in force on the day as a struct, or null.

    Versions and days of a key are sorted together and the last version is carried on; a key's group is as large as its
    versions and days are many."""
    version = F.struct(*[c for c in dimension.columns if c not in keys])
    others = [c for c in pairs.columns if c not in (*keys, "_day")]
    marks = dimension.select(*keys, F.col(valid_from).alias("_day"), F.lit(0).alias("_asks"), version.alias("_v"))
    asked = pairs.select(*keys, "_day", F.lit(1).alias("_asks"), *others)
    order = Window.partitionBy(*keys).orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("_v", ignorenulls=True).over(order)
    found = asked.unionByName(marks.where(F.col("_day").isNotNull()), allowMissingColumns=True).withColumn("_v", carried).where("_asks = 1")
    if respect_valid_to:
        found = found.withColumn("_v", F.when(F.col("_v.valid_to").isNull() | (F.col("_day") < F.col("_v.valid_to")), F.col("_v")))
    return found.select(*keys, "_day", *others, "_v")


def asof_join_by_days(
    rows: DataFrame, dimension: DataFrame, keys: list[str], on_date: Column, valid_from: str = "valid_from", respect_valid_to: bool = False, prefix: str = "", heavy: int = HEAVY
) -> DataFrame:
    """:func:`asof_join` for dimensions of any size."""
    place = [*keys, "_day"]
    dated = rows.withColumn("_day", on_date)
    whole = F.lit(True)
    for c in place:
        whole = whole & F.col(c).isNotNull()
    pairs = dated.where(whole).groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    found = versions_by_day(pairs, dimension, keys, valid_from, respect_valid_to)
    total = F.broadcast(pairs.agg(F.sum("_n").alias("_total")))  # one row
    marked = found.join(total).withColumn("_hot", F.col("_n") * heavy >= F.col("_total")).select(*place, "_v", "_hot")
    hot, rest = F.broadcast(marked.where("_hot").drop("_hot")), marked.where("not _hot").drop("_hot")
    mine = [F.col(f"_v.{c}").alias(prefix + c) for c in dimension.columns if c not in keys]
    shown = [*rows.columns, *mine, F.col("_v").isNotNull().alias(prefix + "_matched")]
    by_broadcast = dated.where(whole).join(hot, place).select(*shown)
    by_key = dated.where(whole).join(hot.select(*place), place, "left_anti").join(rest.hint("merge"), place, "left").select(*shown)
    nothing = dated.where(~whole).withColumn("_v", F.lit(None).cast(found.schema["_v"].dataType)).select(*shown)
    return by_broadcast.unionByName(by_key).unionByName(nothing)


def lookup_all(asked: DataFrame, dimension: DataFrame, keys: list[str], day: str, prefix: str = "") -> DataFrame:
    """:func:`lookup` of every row of ``asked`` (keys and a column ``day``), valid_to respected."""
    return asof_join(asked, dimension, keys, F.col(day), respect_valid_to=True, prefix=prefix)


def lookup(dimension: DataFrame, key: dict[str, str], day: str, valid_from: str = "valid_from") -> DataFrame:
    """The version of one key in force on a day, valid_to respected: one row or none."""
    rows = dimension.where((F.col(valid_from) <= F.lit(day).cast("date")) & (F.col("valid_to").isNull() | (F.lit(day).cast("date") < F.col("valid_to"))))
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc(valid_from)).limit(1)


def lookup_environmental_factors(factors: DataFrame, provider: str, model: str, day: str) -> DataFrame:
    return lookup(factors, {"provider": provider, "model": model}, day)


def lookup_grid_factors(grids: DataFrame, region: str, day: str) -> DataFrame:
    return lookup(grids, {"region": region}, day)
