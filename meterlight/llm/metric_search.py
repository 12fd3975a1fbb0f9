"""Exact top-k search by inner product with M-trees.

Index. Vectors are dealt to the nearest of about sqrt(n) pivots, at most PIVOTS, and range partitioned in this order, so that
near ones lie together and a hot pivot is cut into parts. Each task cuts its part into trees of at most TREE vectors: leaf
pages of at most PAGE vectors, and inner nodes of at most FAN pages. Pages and nodes have a routing object (one of their
vectors), a covering radius, and the greatest norm below them; vectors and pages store their distance to the routing object
above them. A tree is one row of the written index.

Search, for blocks of queries with a bounded number of components. By |q - x|^2 = |q|^2 + |x|^2 - 2 <q, x> a lower bound of a
distance is an upper bound of a score, and by Cauchy and Schwarz <q, x> is at most <q, p> + |q| |x - p|. Stored distances bound
the scores of a node's pages and of a page's vectors by the triangle inequality; only what these bounds leave is computed. Each
query takes the pages of a tree best first. A first pass, one page of each tree for a query, gives the k-th best score so
far over all trees; the second pass starts from it and ends at the first page that cannot reach it.

Scores are exact: products are taken in doubles where these hold them exactly, else in integers of any size; scores beyond 64
bits are cut off there. Bounds are widened by more than their rounding.

Defined cases: vectors that are null, or hold a null or a component that is not finite (times 256), take no part; components
beyond 64 bits are cut off there. Vectors of different lengths are compared as if the shorter one ended in zeros, so an empty
vector scores 0. Rows are told apart: a query's own row is no candidate, but another row with its id is. Null ids are never
queries and come last among equal scores. Each query row gets a ranking. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Results of a query; factor of the components before they are rounded down.
BEST, SCALE = 5, 256
#: Vectors of a leaf page, pages of an inner node, vectors of a tree; pivots by which vectors are put in order.
PAGE, FAN, TREE, PIVOTS = 64, 16, 8192, 4096
#: Components of the queries that are searched for at a time.
BLOCK = 1 << 20
#: Relative width that bounds get for rounding.
SLACK = 1e-9
ABSENT = -(2**63)


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """no (a number of the row), id and v (whole components) of the vectors that take part; written."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    found = rows.where(F.col(vector_col).isNotNull() & whole).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c)).alias("v"))
    return materialize(found.withColumn("no", F.monotonically_increasing_id()), "vectors")


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """The components of a list column in one array, and the rows' offsets."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, cut off at 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ABSENT + 1, 2**63 - 1).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the vectors of two arrays of doubles."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _resized(a: np.ndarray, dim: int) -> np.ndarray:
    return a[:, :dim] if a.shape[1] >= dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def _halved(points: np.ndarray, limit: int) -> list[np.ndarray]:
    """Groups of at most ``limit`` near points: each group is split between two far points, equal points by number."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        group = open_.pop()
        if len(group) <= limit:
            done.append(group)
            continue
        near = points[group]
        first = distances(near, near[:1])[:, 0].argmax()
        one = distances(near, near[first : first + 1])[:, 0]
        second = one.argmax()
        order = np.argsort(one - distances(near, near[second : second + 1])[:, 0], kind="stable")
        half = max(limit, len(group) // 2 // limit * limit)
        open_ += [group[order[half:]], group[order[:half]]]
    return done


def _center(points: np.ndarray) -> int:
    """The point nearest to the mean."""
    return int(distances(points, points.mean(0, keepdims=True))[:, 0].argmin())


def build_tree(ids: np.ndarray, no_id: np.ndarray, nos: np.ndarray, vectors: np.ndarray) -> dict:
    """One tree as a row. Vectors lie in the order of their pages, pages in that of their nodes."""
    points = vectors.astype(float)
    pages = _halved(points, PAGE)
    objects = np.array([page[_center(points[page])] for page in pages])
    nodes = _halved(points[objects], FAN)
    pages, objects = [pages[i] for node in nodes for i in node], objects[np.concatenate(nodes)]
    order = np.concatenate(pages)
    norms = np.sqrt((points * points).sum(1))
    own = [distances(points[page], points[o : o + 1])[:, 0] for page, o in zip(pages, objects, strict=True)]
    ends = np.cumsum([len(node) for node in nodes])
    centers, above, radii, greatest = [], [], [], []
    for a, b in zip(ends - [len(node) for node in nodes], ends, strict=True):
        center = objects[a:b][_center(points[objects[a:b]])]
        inside = np.concatenate(pages[a:b])
        centers.append(center)
        above.append(distances(points[objects[a:b]], points[center : center + 1])[:, 0])
        radii.append(distances(points[inside], points[center : center + 1]).max())
        greatest.append(norms[inside].max())
    row = {
        "ids": ids[order].astype("<i8"), "no_id": no_id[order], "nos": nos[order].astype("<i8"), "vectors": vectors[order].astype("<i8"), "to_object": np.concatenate(own),
        "page_end": np.cumsum([len(p) for p in pages]), "page_object": vectors[objects].astype("<i8"), "page_radius": np.array([d.max() for d in own]), "page_norm": np.array([norms[p].max() for p in pages]), "to_node": np.concatenate(above),
        "node_end": ends, "node_object": vectors[centers].astype("<i8"), "node_radius": np.array(radii), "node_norm": np.array(greatest),
    }
    return {k: v.tobytes() for k, v in row.items()} | {"dim": vectors.shape[1]}


COLUMNS = ["ids", "no_id", "nos", "vectors", "to_object", "page_end", "page_object", "page_radius", "page_norm", "to_node", "node_end", "node_object", "node_radius", "node_norm"]


def _nearest(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with dim and pivot, the number of the nearest pivot. The pivots are about sqrt(n) of the vectors."""
    wanted = min(PIVOTS, math.isqrt(n) + 1)
    dims = F.size("v")
    length = rows.agg(F.mode(dims)).first()[0]
    chosen = rows.where(dims == length).select("v").orderBy(F.xxhash64("no")).limit(wanted).collect()  # PIVOTS vectors at most
    shared = rows.sparkSession.sparkContext.broadcast(np.array([r.v for r in chosen], float).reshape(len(chosen), length))

    def compute(batches):
        pivots = shared.value
        for batch in batches:
            flat, offsets = _matrix(batch.column("v"))
            sizes = np.diff(offsets)
            found = np.zeros(len(sizes), np.int64)
            same = np.flatnonzero(sizes == pivots.shape[1])
            if pivots.shape[1]:
                for k in range(0, len(same), 1024):
                    part = same[k : k + 1024]
                    found[part] = distances(flat[offsets[part][:, None] + np.arange(pivots.shape[1])].astype(float), pivots).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(found)], names=[*batch.schema.names, "dim", "pivot"])

    return rows.select("no", "id", "v").mapInArrow(compute, "no bigint, id bigint, v array<bigint>, dim bigint, pivot bigint")


def build_index(rows: DataFrame) -> DataFrame:
    """The trees over :func:`quantized` rows, written, one row per tree."""
    n = rows.count()
    schema = pa.schema([(c, pa.binary()) for c in COLUMNS] + [("dim", pa.int64())])

    def tree(part: list) -> pa.RecordBatch:
        id = pa.concat_arrays([p[0] for p in part])
        return pa.RecordBatch.from_pylist([build_tree(
            np.asarray(id.fill_null(0)), np.asarray(id.is_null()).astype(bool), np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part]),
        )], schema)

    def compute(batches):
        part, size, dim = [], 0, -1
        for batch in batches:
            dims, (flat, offsets) = np.asarray(batch.column("dim")), _matrix(batch.column("v"))
            turns = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for start, end in zip(turns[:-1], turns[1:], strict=True):
                while start < end:
                    if part and (dims[start] != dim or size == TREE):
                        yield tree(part)
                        part, size = [], 0
                    dim = int(dims[start])
                    stop = min(end, start + TREE - size)
                    vectors = flat[offsets[start] : offsets[stop]].reshape(stop - start, dim)
                    part.append((batch.column("id").slice(start, stop - start), np.asarray(batch.column("no"))[start:stop], vectors))
                    size, start = size + stop - start, stop
        if part:
            yield tree(part)

    if not n:
        return materialize(rows.sparkSession.createDataFrame([], ", ".join(f"{c} binary" for c in COLUMNS) + ", dim bigint"), "trees")
    parts = max(1, -(-n // TREE))
    placed = _nearest(rows, n).repartitionByRange(parts, "dim", "pivot", F.xxhash64("no")).sortWithinPartitions("dim", "pivot")
    found = placed.mapInArrow(compute, ", ".join(f"{c} binary" for c in COLUMNS) + ", dim bigint")
    return materialize(found, "trees", **{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})


class _Tree:
    """A tree as arrays."""

    def __init__(self, row: dict):
        dim = row["dim"]
        get = lambda name, kind=float: np.frombuffer(row[name], kind)
        self.dim, self.ids, self.no_id, self.nos = dim, get("ids", "<i8"), get("no_id", bool), get("nos", "<i8")
        self.vectors = get("vectors", "<i8").reshape(len(self.ids), dim)
        self.to_object, self.to_node = get("to_object"), get("to_node")
        self.page_end, self.node_end = get("page_end", np.int64), get("node_end", np.int64)
        self.page_start, self.node_start = np.append(0, self.page_end[:-1]), np.append(0, self.node_end[:-1])
        self.page_object = get("page_object", "<i8").reshape(len(self.page_end), dim).astype(float)
        self.node_object = get("node_object", "<i8").reshape(len(self.node_end), dim).astype(float)
        self.page_radius, self.page_norm, self.node_radius, self.node_norm = get("page_radius"), get("page_norm"), get("node_radius"), get("node_norm")
        points = self.vectors.astype(float)
        self.norms = np.sqrt((points * points).sum(1))


def _highest(distance: np.ndarray, square: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The highest score of vectors with a norm of ``norm`` at most and a distance of ``distance`` at least."""
    return (square + norm * norm - distance * distance) / 2


class Search:
    """The best candidates of a block of queries so far. ``least``: scores that results reach, by query."""

    def __init__(self, nos: np.ndarray, queries: list[np.ndarray], k: int, least: np.ndarray):
        self.nos, self.queries, self.k, self.least = nos, queries, k, least.copy()
        n = len(nos)
        self.scores = np.full((n, k), ABSENT)
        self.ids, self.no_id, self.found = np.zeros((n, k), np.int64), np.ones((n, k), bool), np.full((n, k), -1)
        self.sized: dict[int, tuple] = {}
        self.computed = 0

    def _block(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries in ``dim`` components, as integers and doubles, and their squares."""
        if dim not in self.sized:
            whole = np.stack([_resized(q[None, :], dim)[0] for q in self.queries]) if self.queries else np.zeros((0, dim), np.int64)
            points = whole.astype(float)
            self.sized = {dim: (whole, points, (points * points).sum(1))}  # trees of one length follow each other
        return self.sized[dim]

    def visit(self, tree: _Tree, pages: int | None = None) -> None:
        """Take in a tree; ``pages``: so many of its pages for each query."""
        whole, points, square = self._block(tree.dim)
        bounds = self._page_bounds(tree, points, square)
        order = np.argsort(-bounds, axis=1)
        start, step, n = 0, 1, bounds.shape[1]
        while start < (n if pages is None else min(pages, n)):
            chosen = order[:, start : start + step]
            query, at = np.nonzero(np.take_along_axis(bounds, chosen, 1) >= self.least[:, None])
            if not len(query):
                break
            page = chosen[query, at]
            by_page = np.argsort(page, kind="stable")
            query, page = query[by_page], page[by_page]
            for part in np.split(np.arange(len(page)), np.flatnonzero(np.diff(page)) + 1):
                self._read_page(tree, int(page[part[0]]), query[part], whole, points, square)
            start, step = start + step, 2 * step if pages is None else step

    def _page_bounds(self, tree: _Tree, points: np.ndarray, square: np.ndarray) -> np.ndarray:
        """The highest score that each page can hold for each query, minus infinity where its node is ruled out."""
        bounds = np.full((len(points), len(tree.page_end)), -math.inf)
        size = np.sqrt(square)
        to_nodes = distances(points, tree.node_object)
        inner = points @ tree.node_object.T
        for node, (a, b) in enumerate(zip(tree.node_start, tree.node_end, strict=True)):
            away, norm = to_nodes[:, node], tree.node_norm[node]
            wide = SLACK * (square + norm * norm) + 1
            most = np.minimum(_highest(np.maximum(away - tree.node_radius[node], 0), square, norm), inner[:, node] + size * tree.node_radius[node])
            open_ = np.flatnonzero(most + wide >= self.least)
            if not len(open_):
                continue
            # by the pages' stored distances to the node's object, then by their own
            norm, radius = tree.page_norm[a:b], tree.page_radius[a:b]
            stored = np.maximum(np.abs(away[open_, None] - tree.to_node[a:b]) - radius, 0)
            most = _highest(stored, square[open_, None], norm) + SLACK * (square[open_, None] + norm * norm) + 1
            some = (most >= self.least[open_, None]).any(1)
            open_, most = open_[some], most[some]
            kept = np.flatnonzero((most >= self.least[open_, None]).any(0))
            if not len(kept):
                continue
            own = np.maximum(distances(points[open_], tree.page_object[a + kept]) - radius[kept], 0)
            ahead = points[open_] @ tree.page_object[a + kept].T + size[open_, None] * radius[kept]
            exact = np.minimum(_highest(own, square[open_, None], norm[kept]), ahead) + SLACK * (square[open_, None] + norm[kept] ** 2) + 1
            bounds[np.ix_(open_, a + kept)] = np.minimum(most[:, kept], exact)
        return bounds

    def _read_page(self, tree: _Tree, page: int, query: np.ndarray, whole: np.ndarray, points: np.ndarray, square: np.ndarray) -> None:
        """Compare queries with the vectors of a page that their stored distances do not rule out."""
        inside = np.arange(tree.page_start[page], tree.page_end[page])
        away = distances(points[query], tree.page_object[page : page + 1])
        stored = np.abs(away - tree.to_object[inside])
        most = _highest(stored, square[query, None], tree.norms[inside]) + SLACK * (square[query, None] + tree.norms[inside] ** 2) + 1
        open_ = most >= self.least[query, None]
        query, inside = query[open_.any(1)], inside[open_.any(0)]
        if not len(query) or not len(inside):
            return
        scores = products(whole[query], tree.vectors[inside])
        self.computed += scores.size
        scores[self.nos[query][:, None] == tree.nos[inside]] = ABSENT
        better = (scores >= self.least[query, None]) & (scores > ABSENT)
        some = better.any(1)
        if some.any():
            inside, scores = inside[better.any(0)], scores[np.ix_(some, better.any(0))]
            self._take(query[some], scores, tree.ids[inside], tree.no_id[inside], tree.nos[inside])

    def _take(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, nos: np.ndarray) -> None:
        shape, scores = scores.shape, np.concatenate([self.scores[query], scores], 1)
        ids, no_id, nos = (np.concatenate([a[query], np.broadcast_to(b, shape)], 1) for a, b in ((self.ids, ids), (self.no_id, no_id), (self.found, nos)))
        order = np.lexsort((ids, no_id, ~scores), axis=1)[:, : self.k]  # ~: descending, without overflow
        for mine, new in ((self.scores, scores), (self.ids, ids), (self.no_id, no_id), (self.found, nos)):
            mine[query] = np.take_along_axis(new, order, 1)
        self.least[query] = np.maximum(self.least[query], self.scores[query, self.k - 1])

    def results(self) -> tuple[np.ndarray, ...]:
        """Query (its place in the block), score, id, and whether the id is null, of all candidates found."""
        query, at = np.nonzero(self.scores > ABSENT)
        return query, self.scores[query, at], self.ids[query, at], self.no_id[query, at]


def _pass(index: DataFrame, shared, k: int, pages: int | None) -> DataFrame:
    """query, score, vec_id: the best of each task."""

    def compute(batches):
        nos, queries, least = shared.value
        search = Search(nos, queries, k, least)
        for batch in batches:
            for row in batch.to_pylist():
                search.visit(_Tree(row), pages)
        query, score, ids, no_id = search.results()
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=no_id)], names=["query", "score", "vec_id"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    rows = index.mapInArrow(compute, "query bigint, score bigint, vec_id bigint")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: DataFrame, rows: list, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of a block of queries."""
    spark = index.sparkSession
    nos, queries = np.array([r.no for r in rows], np.int64), [np.array(r.v, np.int64) for r in rows]
    least = np.full(len(rows), ABSENT)
    for r in _pass(index, spark.sparkContext.broadcast((nos, queries, least)), k, 1).where(F.col("rank") == k).collect():  # a row per query
        least[r.query] = r.score
    found = _pass(index, spark.sparkContext.broadcast((nos, queries, least)), k, None)
    names = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], "query bigint, query_id bigint")
    return found.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: Column, k: int = BEST, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` vectors of highest score for each row of which ``queries`` (a condition on
    the column id) holds."""
    spark = rows.sparkSession
    vectors = quantized(rows, id_col, vector_col)
    index = build_index(vectors)
    asked = vectors.where(queries)
    n_blocks = max(1, -(-(asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0) // block))
    result = None
    for b in range(n_blocks):
        chosen = asked.where(F.pmod(F.xxhash64("no"), F.lit(n_blocks)) == b).collect()
        if chosen:
            found = materialize(_search_block(index, chosen, k), "neighbours")
            result = found if result is None else result.unionByName(found)
    discard(index, vectors)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint") if result is None else result


def op12_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of ``embeddings`` for each whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.r AS q, q.vec_id AS query_id, x.r, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""
