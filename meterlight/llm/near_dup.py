"""Near-dedup by five-word shingles: documents whose exact Jaccard similarity is 0.8 or more are one class.

Candidates come from two sources. SimHash: fingerprints of the shingle set that are equal or, by the pigeonring
filter of :mod:`simhash`, differ in two bits at most. As two texts of a similarity of 0.8 differ in ten of 64 bits
on the average, these alone would miss most, so MinHash follows: sets that share one of BANDS keys, each
made of ROWS minima of the hashed shingles, so a pair of similarity s is found with probability
1 - (1 - s^ROWS)^BANDS at least: 0.997 at 0.8, 0.9999 at 0.85. Every candidate is then decided by the exact
similarity of the whole texts' shingle sets.

A bucket of a few sets is paired off. All of a larger one is compared with a few pivots, and what is unlike them all
with others, for ``rounds`` rounds. Then only buckets that still hold sets of different components matter, and in
them only pairs of different components: buckets of up to ``bucket_limit`` sets are paired off so, the sets of larger
ones are joined by their rarest shingles. With shingles in order of rarity, the first one that two similar sets have
in common lies in the first n - t * n + 1 of the larger and the first n - 2t / (1 + t) * n + 1 of the smaller (n
shingles, similarity t); what follows it must be enough for the overlap that the sizes ask for. Rows of one shingle
are split by size, and those of one component are a single group until a group of another one fits. So no pair of a
bucket is lost.

Defined cases: texts are lower-cased and cut at white space; one of fewer than WORDS words is a single
shingle, and texts without words are alike. Texts with the same shingles are one class without comparison.
Ids may repeat or be null. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import discard, join_spread, keep_rows, label_rows, materialize, text_key
from .components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
SEED = 42
#: Sets of a bucket that are paired off at once; sets of a bucket of which pairs of different components are; pivots of a
#: larger one, on the average, and rounds of pivots.
PAIRED, BUCKET_LIMIT, PIVOTS, ROUNDS = 8, 128, 4, 2


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, node (a hash of the shingle set), fp (its SimHash) and bands of every row."""

    def compute(batches):
        random = np.random.default_rng(SEED)
        by, turn = (random.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
        by |= np.uint32(1)
        for batch in batches:
            texts = batch.column("text")
            nodes, fps, bands = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), np.zeros((len(texts), BANDS), np.uint64)
            for i, text in enumerate(texts):
                found = shingles(text.as_py())
                nodes[i] = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                fps[i] = simhash.majority(found)
                # 32 bits multiply several times faster; a collision only adds a candidate.
                least, short = np.full(BANDS * ROWS, ~np.uint32(0)), (found >> np.uint64(32)).astype(np.uint32)
                for k in range(0, len(short), 1024):
                    part = short[k : k + 1024] ^ turn
                    part *= by
                    np.minimum(least, part.min(axis=1), out=least)
                data = least.tobytes()
                bands[i] = [xxhash.xxh64_intdigest(data[4 * ROWS * b : 4 * ROWS * (b + 1)], b) for b in range(BANDS)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists],
                names=["id", "text_key", "node", "fp", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "id bigint, text_key bigint, node bigint, fp bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node and shingles of the sets ``nodes`` (node, text_key)."""

    def compute(batches):
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).join(nodes, "text_key")
    found = texts.select("node", "text").mapInArrow(compute, "node bigint, shingles array<bigint>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _compared(pairs: DataFrame, sets: DataFrame, width: float, cells: float | None = None) -> DataFrame:
    """u, v and their exact similarity. Written. ``width``: shingles of a set on the average; ``cells``: size of ``pairs``."""
    pairs = materialize(pairs.select("u", "v").distinct(), "pairs", cells)
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    both = F.size(F.array_intersect("u_set", "v_set"))
    joined = join_spread(join_spread(pairs, left, "u"), right, "v", of=pairs)
    compared = materialize(joined.select("u", "v", (both / (F.size("u_set") + F.size("v_set") - both)).alias("similarity")), "compared", (2 * width + 4) * pairs.count())
    discard(pairs)
    return compared


def _crowded(members: DataFrame, least: int = 2) -> DataFrame:
    """bucket and node of the buckets with at least ``least`` sets, and their number n. Written."""
    counts, total = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), members.count()
    return materialize(label_rows(members.select("bucket", "node"), counts, "bucket", "n", total), "buckets", 4 * total)


def _ranked(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """shingle, node, root, size and place (from 1, by rarity): the rarest shingles of each set, of which two similar sets
    have one in common. Written; only shingles of several roots are left."""
    rows = sets.join(nodes, "node").select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    rows = materialize(rows, "shingles")
    total = rows.count()
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle"))
    ranked = label_rows(rows, counts, "shingle", "n", total).withColumn("place", place)
    # Products of doubles may err in the last bits.
    ranked = ranked.where(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1)
    ranked = materialize(ranked.select("shingle", "node", "root", "size", "place"), "ranked", 6 * total)
    discard(rows)
    shared = ranked.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"))
    kept = materialize(label_rows(ranked, shared.where("least < most").select("shingle", "n"), "shingle", "n").drop("n"), "ranked", 6 * total)
    discard(ranked)
    return kept


def _pairs_by_rarity(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: pairs of ``nodes`` (node, root) of different roots that may be similar; none that is is left out. Written."""
    written = _ranked(nodes, sets, similarity)
    cells = 16 * written.count()
    least = 2 * similarity / (1 + similarity)
    # Sizes of similar sets are of one class or of two that follow each other; a class is a trifle wider than that takes.
    ranked = written.withColumn("class", F.floor(F.log("size") / F.lit(-np.log(similarity) * (1 + 1e-6)))).withColumn("rest", F.col("size") - F.col("place"))
    smaller = ranked.where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    smaller = smaller.withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
    group = F.xxhash64("shingle", "class", "root")

    def groups(rows, side):
        found = rows.groupBy(F.xxhash64("shingle", "class").alias("key"), group.alias(f"{side}_group"), F.col("root").alias(f"{side}_root"))
        ends = F.max("rest").alias(f"{side}_rest"), F.min("size").alias(f"{side}_least"), F.max("size").alias(f"{side}_most")
        return materialize(found.agg(*ends), "groups", cells)

    left, right = groups(smaller, "u"), groups(ranked, "v")
    size = 8 * (left.count() + right.count())
    # A key in common may be a collision, which only adds a candidate.
    enough = 1 + F.least("u_rest", "v_rest") >= similarity / (1 + similarity) * (F.col("u_least") + F.col("v_least")) - 1e-9
    sizes = (F.col("u_least") <= F.col("v_most")) & (F.col("u_most") >= similarity * F.col("v_least") - 1e-9)
    met = join_spread(left, right, "key").where((F.col("u_root") != F.col("v_root")) & enough & sizes)
    met = materialize(met.select("u_group", "v_group").distinct(), "met", size)
    discard(left, right)

    def side(rows, name):
        return rows.select(group.alias(f"{name}_group"), F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("rest").alias(f"{name}_rest"))

    found = join_spread(join_spread(met, side(smaller, "u"), "u_group"), side(ranked, "v"), "v_group", of=met)
    enough = 1 + F.least("u_rest", "v_rest") >= similarity / (1 + similarity) * (F.col("u_size") + F.col("v_size")) - 1e-9
    sizes = (F.col("u_size") <= F.col("v_size")) & (F.col("u_size") >= similarity * F.col("v_size") - 1e-9)
    pairs = materialize(found.where(enough & sizes & F.expr("u <> v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs", cells + 4 * met.count())
    discard(met, written)
    return pairs


def _pairs(members: DataFrame, *keep: str) -> DataFrame:
    """u, v: all pairs of each bucket, or those that differ in the columns ``keep``. For small buckets."""
    left, right = (members.select("bucket", F.col("node").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in keep)) for c in "uv")
    found = left.join(right, "bucket").where("u < v")
    for k in keep:
        found = found.where(F.col(f"u_{k}") != F.col(f"v_{k}"))
    return found.select("u", "v")


def links(
    members: DataFrame,
    sets: DataFrame,
    candidates: DataFrame | None = None,
    similarity: float = SIMILARITY,
    bucket_limit: int = BUCKET_LIMIT,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """Edges u, v, and their components' roots (node, root): every pair of one bucket (members: bucket, node, and n where the
    sets of each bucket have been counted) and every
    pair of ``candidates`` (u, v) that is at least so similar is an edge or joined by a path of edges, and every edge is such a pair."""
    members = members if "n" in members.columns else _crowded(members)
    paired = min(PAIRED, bucket_limit)
    width = sets.agg(F.coalesce(F.avg(F.size("shingles")), F.lit(0.0))).first()[0]
    small = PAIRED * members.count() + (0 if candidates is None else 2 * candidates.count())  # at most so many cells of pairs
    pairs = [_pairs(members.where(F.col("n") <= paired))] + ([] if candidates is None else [candidates.select("u", "v")])
    near, waiting = [], reduce(DataFrame.unionByName, pairs)
    crowded = members.where(F.col("n") > paired)

    def similar(*compared):
        return reduce(DataFrame.unionByName, compared).where(F.col("similarity") >= similarity).select("u", "v")

    large = crowded
    for turn in range(rounds):
        if large.isEmpty():
            break
        # The same nodes come first in every bucket, so that buckets of much the same sets have much the same pivots.
        order = F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 33) / F.lit(float(1 << 31))
        chosen = large.where(order * F.col("n") < pivots).select("bucket", F.col("node").alias("pivot"))
        stars = materialize(join_spread(large.select("bucket", "node"), chosen, "bucket").where("node <> pivot"), "stars")
        turned = stars.select(F.col("pivot").alias("u"), F.col("node").alias("v"))
        compared = _compared(turned if waiting is None else turned.unionByName(waiting), sets, width, 2 * stars.count() + small)
        near.append(compared)
        waiting = None
        known = similar(compared).select(F.col("u").alias("pivot"), F.col("v").alias("node"))
        done = stars.join(known, ["pivot", "node"]).select("bucket", "node").unionByName(chosen.select("bucket", F.col("pivot").alias("node")))
        rest = materialize(large.select("bucket", "node").join(done, ["bucket", "node"], "left_anti"), "rest", 4 * (large.count() + stars.count()))
        large = _crowded(rest)
        discard(stars, rest)
    if waiting is not None:
        near.append(_compared(waiting, sets, width, small))
    compared_cells = 2 * sum(c.count() for c in near)
    roots = connected_components(similar(*near), compared_cells)
    if crowded.isEmpty():
        return similar(*near), roots
    named = crowded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    cells = 4 * crowded.count() + 2 * compared_cells
    named = materialize(named, "members", cells)
    mixed = named.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"))
    named = materialize(label_rows(named, mixed.where("least < most").select("bucket", "n"), "bucket", "n"), "mixed", cells)
    left = named.where(F.col("n") > bucket_limit).select("node", "root").distinct()
    found = _pairs(named.where(F.col("n") <= bucket_limit), "root")
    if not left.isEmpty():
        found = found.unionByName(_pairs_by_rarity(left, sets, similarity))
    known = reduce(DataFrame.unionByName, near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # Pairs are not counted before they are made: of small buckets they are bucket_limit / 2 to a set at most.
    found = materialize(found.distinct(), "pairs", bucket_limit * named.count())
    more = _compared(found.join(known, ["u", "v"], "left_anti"), sets, width, 2 * found.count() + compared_cells)
    discard(found)
    # Only classes are left to be joined, by their roots.
    ends = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv")
    bridges = similar(more).join(next(ends), "u", "left").join(next(ends), "v", "left")
    joined = connected_components(bridges.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")), 8 * more.count() + 2 * compared_cells)
    last = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(last, "root", "left")
    named = label_rows(roots, sizes.select("root", F.coalesce("last", "root").alias("last"), "n"), "root", "n")
    return similar(*near, more), named.select("node", F.col("last").alias("root")).unionByName(joined).distinct()


def _simhash_pairs(classes: DataFrame) -> DataFrame:
    """u, v: one set of each of two fingerprints (classes: node, fp) that differ in at most two bits."""
    fps = materialize(classes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints", 2 * classes.count())
    cells = 16 * fps.count()  # eight chains of two values
    found = materialize(simhash.links(fps.select("fp")), "links", cells)
    left, right = (fps.select(F.col("fp").alias(f"{c}_fp"), F.col("node").alias(c)) for c in "uv")
    found = found.select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp"))
    named = join_spread(join_spread(found, left, "u_fp"), right, "v_fp", of=found)
    return materialize(named.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "candidates", cells)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row of ``docs`` per class: that with the least id (null ids last), then text key."""
    rows = materialize(signatures(docs, id_col, text_col), "signatures")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    classes = rows.groupBy("node").agg(F.min(rank).alias("best"), F.min(F.struct("text_key", "fp", "bands")).alias("one"))
    classes = materialize(classes, "classes", (BANDS + 8) * rows.count())
    # Sets of one fingerprint make a bucket, too.
    keys = F.concat("one.bands", F.array(F.xxhash64(F.lit("fp"), "one.fp")))
    members = _crowded(classes.select("node", F.explode(keys).alias("bucket")))
    candidates = _simhash_pairs(classes.select("node", "one.fp"))
    wanted = members.select("node").unionByName(candidates.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = materialize(_sets(docs, classes.join(wanted, "node").select("node", "one.text_key"), text_col), "shingles")
    _, roots = links(members, sets, candidates, similarity, bucket_limit)
    roots = roots.withColumnRenamed("node", "linked")
    named = classes.select("node", "best").join(roots, F.col("node") == F.col("linked"), "left")
    best = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    best = materialize(best, "best", 8 * classes.count())
    return keep_rows(docs, best.select("best.id", "best.text_key"), id_col, text_col)
