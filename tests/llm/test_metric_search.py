import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlight.llm import metric_search


def brute_force(rows, k=5, every=50):
    whole = [
        (id, [math.floor(256 * float(np.float64(x))) for x in v]) for id, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for q, (query, a) in enumerate(whole):
        if query is None or query % every:
            continue
        scored = sorted((-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63), id is None, id or 0) for r, (id, b) in enumerate(whole) if r != q)[:k]  # noqa: B905
        found += [(query, rank, None if none else id, -s) for rank, (s, none, id) in enumerate(scored, 1)]
    return by_text(found)


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def searched(spark, rows, k=5, every=50, **given):
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, embedding array<double>, v string, rank int").repartition(3)
    return by_text(metric_search.search(frame, F.col("id") % every == 0, k, **given).collect())


@pytest.mark.parametrize("page,fan,tree,pivots", [(64, 16, 8192, 4096), (4, 3, 50, 5), (8, 2, 200, 1)])
def test_random_vectors(spark, monkeypatch, page, fan, tree, pivots):
    for name, value in (("PAGE", page), ("FAN", fan), ("TREE", tree), ("PIVOTS", pivots)):
        monkeypatch.setattr(metric_search, name, value)
    rng = np.random.default_rng(page)
    centers = rng.normal(size=(6, 5)) * 2
    points = centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 5)) * 0.1
    points[100:200] = points[100]  # a group of copies
    points[200:220] *= rng.uniform(0, 30, (20, 1))  # and very long ones
    rows = [(int(k), p.tolist()) for k, p in enumerate(points)]
    assert searched(spark, rows, every=10, block=100) == brute_force(rows, every=10)
    assert searched(spark, rows, k=130, every=100) == brute_force(rows, k=130, every=100)


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None), (50, None), (50, [1.0, None]), (100, [nan, 1.0]), (150, [inf, 1.0]), (1, [-inf]),
        (200, []), (250, [3.0]), (300, [1.0, 1.0, 5.0]), (-50, [-1.0, -0.001]), (3, [0.999 / 256, 1.0]), (4, [1.0, 2.0, -7.0, 1.0]), (350, [0.0, 0.0]),
    ]
    assert searched(spark, rows) == brute_force(rows)
    assert searched(spark, rows, k=1) == brute_force(rows, k=1)
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, []) == []


def test_large_components(spark):
    rows = [(k * 25, [float(2**30 + k % 7), float(-(2**29) * (k % 3)), 1.0 + k]) for k in range(40)]
    assert searched(spark, rows) == brute_force(rows)


def test_bounds_rule_out_most_vectors():
    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (40, 16))
    vectors = (centers[np.repeat(np.arange(40), 100)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    ids = np.arange(4000)
    tree = metric_search._Tree(metric_search.build_tree(ids, np.zeros(4000, bool), ids, vectors))
    search = metric_search.Search(ids[::100], list(vectors[::100]), 5, np.full(40, metric_search.ABSENT))
    search.visit(tree)
    assert search.computed < 40 * 4000 / 3


def test_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    found = by_text(metric_search.op12_metric_search(spark, folder).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert found == by_text(db.execute(metric_search.ORACLE_SQL).fetchall())
    assert found == brute_force([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
