import pytest
from pyspark.sql import functions as F

from meterlight.llm import common
from meterlight.llm.components import connected_components


def hot(spark, n):
    """A key with a third of the rows, others with one or two."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - F.col("id") % 2).alias("key"), "id")


@pytest.mark.parametrize("n", [0, 300, 6000])
def test_joins_of_hot_keys_are_plain_joins(spark, n):
    rows = hot(spark, n)
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    expected = sorted(map(tuple, rows.join(groups, "key").select("key", "id", "n").collect()))
    assert len(expected) == n
    assert sorted(map(tuple, common.label_rows(rows, groups, "key", "n").select("key", "id", "n").collect())) == expected
    others = groups.where("key % 4 = 0").select("key", F.explode(F.array("n", F.lit(-1))).alias("m"))
    spread = common.join_spread(rows, others, "key").select("key", "id", "m")
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, rows.join(others, "key").select("key", "id", "m").collect()))


@pytest.mark.parametrize(
    ("edges", "roots"),
    [
        ([], {}),
        ([(3, 1), (3, 2)], {1: 1, 2: 1, 3: 1}),  # two roots of one vertex
        ([(i, i + 1) for i in range(9)], dict.fromkeys(range(10), 0)),
        ([(5, 5), (9, 7), (7, 9), (-3, 7)], {-3: -3, 7: -3, 9: -3}),
        ([(0, i) for i in range(1, 2500)] + [(5000, 5001)], dict.fromkeys(range(2500), 0) | {5000: 5000, 5001: 5000}),
    ],
)
def test_components(spark, edges, roots):
    found = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(found) == len(roots)
    assert {r.node: r.root for r in found} == roots


def test_shuffles_are_sized_by_what_is_shuffled(spark):
    before = common.shuffle_partitions(spark)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        cores = spark.sparkContext.defaultParallelism
        for cells, partitions in ((None, 50), (0, cores), (20 * common.CELLS - 1, 20), (10**15, 50)):
            with common.sized_shuffles(spark, cells):
                assert common.shuffle_partitions(spark) == partitions
            assert common.shuffle_partitions(spark) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))
