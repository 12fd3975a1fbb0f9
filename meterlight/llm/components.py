"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, in which a vertex with a thousandth of the edges or more goes by
broadcast, so no vertex's neighbours are gathered in memory or in one task, and the number of rounds grows with the logarithm of the longest path. Edges are written to the shared
folder after every round; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, label_rows, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the least vertex around it. ``n``: number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return label_rows(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every smaller neighbour of a vertex, and the vertex, to the least of them. ``n``: number of edges."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    others = label_rows(down, least.where("n > 1"), "u", "n", n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, cells: float | None = None) -> DataFrame:
    """``edges`` has bigint columns u, v. Returns node, root (the least node of its component) for
    every node that has an edge to another node; self-loops and repeated edges do no harm. ``cells``: see :func:`common.materialize`."""
    edges = materialize(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v").distinct(), "edges", cells)
    before = _state(edges)
    while before[0]:
        cells = 8 * before[0]  # each edge from both ends, with what it is joined to
        step = materialize(_large_star(edges, before[0]), "edges", cells)
        discard(edges)
        if _state(step) == before and step.select("u").distinct().count() == before[0]:
            edges = step  # nothing is both a neighbour's root and below another vertex, and each vertex has one root
            break
        edges = materialize(_small_star(step, before[0]), "edges", cells)
        discard(step)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
