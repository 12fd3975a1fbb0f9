import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlight.operators import asof

DAY = dt.date(2024, 1, 1)
KINDS = {"rows": "id int, a string, b int, at date", "versions": "a string, b int, valid_from date, valid_to date, rate double"}


def day(k):
    return None if k is None else DAY + dt.timedelta(days=k)


def brute_force(rows, versions, respect):
    found = []
    for id, a, b, at in rows:
        fits = [v for v in versions if None not in (a, b, at, v[2]) and (v[0], v[1]) == (a, b) and v[2] <= at]
        best = max(fits, key=lambda v: v[2], default=None)
        if best and respect and best[3] is not None and at >= best[3]:
            best = None
        found.append((id, best and best[4], best and best[2], best is not None))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    key = lambda: (rng.choice(["x", "y", "z", None]), rng.choice([1, 2, None]))
    starts = sorted({(*key(), rng.randrange(0, 60)) for _ in range(60)}, key=str)
    versions = [(a, b, day(k), rng.choice([None, day(k + 3), day(k)]), rng.random()) for a, b, k in starts]
    versions.append(("y", 1, None, None, 1.0))
    rows = [(i, *key(), day(rng.choice([None, *range(-5, 70)]))) for i in range(400)]
    rows += [(1000 + i, "x", 1, day(30)) for i in range(300)]  # one pair of key and day with nearly half of the rows
    rows += [(2000 + i, "none", 1, day(30)) for i in range(100)]  # and one without any version
    return rows, versions


@pytest.mark.parametrize("heavy", [1, 10, 1000])
@pytest.mark.parametrize("respect", [False, True])
def test_by_days(spark, cases, heavy, respect):
    rows, versions = cases
    frame, dimension = spark.createDataFrame(rows, KINDS["rows"]), spark.createDataFrame(versions, KINDS["versions"])
    for joined in (
        asof.asof_join_by_days(frame, dimension, ["a", "b"], F.col("at"), respect_valid_to=respect, prefix="v_", heavy=heavy),
        asof.asof_join(frame, dimension, ["a", "b"], F.col("at"), respect_valid_to=respect, prefix="v_"),
    ):
        assert joined.columns == ["id", "a", "b", "at", "v_valid_from", "v_valid_to", "v_rate", "v__matched"]
        found = joined.select("id", "v_rate", "v_valid_from", "v__matched").collect()
        assert sorted(map(tuple, found), key=str) == brute_force(rows, versions, respect)


def test_empty_tables(spark, cases):
    rows, versions = cases
    frame, dimension = spark.createDataFrame(rows, KINDS["rows"]), spark.createDataFrame(versions, KINDS["versions"])
    join = lambda r, v: asof.asof_join_by_days(r, v, ["a", "b"], F.col("at"))
    assert join(frame.limit(0), dimension).count() == 0
    assert join(frame, dimension.limit(0)).where("not _matched and rate is null").count() == len(rows)


def test_no_task_has_the_rows_of_a_key(spark):
    """A key with most of the rows, and a day of it with a third of all rows, are spread over the tasks."""
    rows = spark.range(60_000, numPartitions=12).select(
        F.col("id").cast("int").alias("id"), F.lit("x").alias("a"), F.lit(1).alias("b"),
        F.date_add(F.lit(DAY), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).cast("int")).alias("at"),
    )
    dimension = spark.createDataFrame([("x", 1, day(k), None, float(k)) for k in range(0, 100, 9)], KINDS["versions"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = asof.asof_join_by_days(rows, dimension, ["a", "b"], F.col("at"))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000
        assert max(sizes) < 6_000
        assert found.where("rate <> floor(datediff(at, date'2024-01-01') / 9) * 9").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_choice_by_size(spark, cases, monkeypatch):
    rows, versions = cases
    frame, dimension = spark.createDataFrame(rows, KINDS["rows"]), spark.createDataFrame(versions, KINDS["versions"])
    small = spark.sql("SELECT * FROM VALUES ('x', 1, DATE '2024-01-05', CAST(NULL AS DATE), 1e0) AS t(a, b, valid_from, valid_to, rate)")
    used = []
    monkeypatch.setattr(asof, "asof_join_by_days", lambda *given: used.append(given))
    asof.asof_join(frame, small, ["a", "b"], F.col("at"))
    assert not used
    asof.asof_join(frame, dimension, ["a", "b"], F.col("at"))  # of unknown size
    assert used
