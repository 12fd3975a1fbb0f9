"""SimHash near-dedup with pigeonring filtering.

A fingerprint is a ring of 8 segments of 8 bits. By the pigeonring principle, two fingerprints that
differ in at most 2 bits have a segment from which every chain of ``l`` consecutive segments differs
in at most ``l * 2 / 8`` bits: the first three segments are equal, and up to seven differ in one bit
at most. The equal 24 bits and their place in the ring are the join key; the longer chains prune the
pairs that meet before the full Hamming distance is taken.

A bucket with more than ``bucket_limit`` fingerprints is not paired off. Its remaining 40 bits are a
ring of 5 segments, of which two consecutive ones must be equal, so the key grows to 40 bits; a
bucket that is still too large links fingerprints through the strings one bit away from both, which
is exact and linear: each fingerprint has 41 such strings within the bucket and a string has at most
41 fingerprints. No pair is lost and no bucket is paired without a bound.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like
any other; equal texts share a fingerprint and one class; only distinct fingerprints are paired. Ids
may repeat or be null (a component without any id has a null id). Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_rows, label_rows, materialize, table, text_key
from .components import connected_components

BITS, SEGMENTS, WIDTH, DISTANCE = 64, 8, 8, 2
SEED = 42
WORDS = 3
#: Fingerprints of a bucket that are compared pair by pair; larger buckets are split (see above).
BUCKET_LIMIT = 256


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the text's word shingles, unsigned."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        first, last = starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    votes = np.zeros(BITS, np.int64)
    values = hashes.astype(">u8")
    for k in range(0, len(values), 1 << 16):
        part = values[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, text_key, fp (bigint: the fingerprint's 64 bits) of every row."""

    def compute(batches):
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), fp], names=["id", "text_key", "fp"])

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(compute, "id bigint, text_key bigint, fp bigint")


def _rotate(value: Column, by: int, bits: int) -> Column:
    if not by:
        return value
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, bits - by)).bitwiseAND(mask)


def _chains(value: Column, segments: int, exact: int) -> Column:
    """For each start in a ring of segments: the ``exact`` leading segments and the remaining bits."""
    bits, low = segments * WIDTH, (segments - exact) * WIDTH
    turned = [_rotate(value, WIDTH * i, bits) for i in range(segments)]
    return F.array(*[
        F.struct(
            F.lit(i).alias("start"),
            F.shiftrightunsigned(t, low).alias("head"),
            t.bitwiseAND(F.lit((1 << low) - 1)).alias("rest"),
        )
        for i, t in enumerate(turned)
    ])


def _meeting(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the number ``n`` of its rows."""
    named, total = rows.withColumn("bucket", F.struct(*key)), rows.count()
    counts = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(label_rows(named, counts, "bucket", "n", total).drop("bucket"), "buckets", len(rows.columns) * total)


def _pairs(rows: DataFrame, key: list[str], rest: str, segments: int, exact: int, distance: int) -> DataFrame:
    """Pairs within buckets that pass the chain budgets, then the full Hamming distance."""
    other = rows.select(*key, F.col("fp").alias("fp2"), F.col(rest).alias("rest2"))
    pairs = rows.select(*key, "fp", rest).join(other, key).where("fp < fp2")
    differ = F.col(rest).bitwiseXOR(F.col("rest2"))
    for length in range(exact + 1, segments):
        budget = length * distance // segments
        pairs = pairs.where(F.bit_count(F.shiftrightunsigned(differ, WIDTH * (segments - length))) <= budget)
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    return pairs.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that differ in at most 2 bits.

    Every edge is such a pair, and every such pair is an edge or, in very large buckets, joined by a
    path of edges.
    """
    chained = fps.select("fp", F.explode(_chains(F.col("fp"), SEGMENTS, 3)).alias("c"))
    rows = _meeting(chained.select("fp", "c.start", "c.head", "c.rest"), ["start", "head"])
    found = _pairs(rows.where(F.col("n") <= bucket_limit), ["start", "head"], "rest", SEGMENTS, 3, DISTANCE)
    large = rows.where(F.col("n") > bucket_limit)
    if large.isEmpty():
        return found.distinct()

    inner = large.select("fp", "start", "head", F.col("rest").alias("tail"), F.explode(_chains(F.col("rest"), 5, 2)).alias("c"))
    key = ["start", "head", "start2", "head2"]
    rows = inner.select("fp", "start", "head", "tail", F.col("c.start").alias("start2"), F.col("c.head").alias("head2"), F.col("c.rest").alias("rest"))
    rows = _meeting(rows, key)
    found = found.unionByName(_pairs(rows.where(F.col("n") <= bucket_limit), key, "rest", 5, 2, DISTANCE))

    near = F.array(F.col("tail"), *[F.col("tail").bitwiseXOR(F.lit(1 << b)) for b in range(40)])
    hubs = rows.where(F.col("n") > bucket_limit).select("start", "head", "tail", "fp").distinct()
    hubs = hubs.select("start", "head", "fp", F.explode(near).alias("near"))
    least = F.min("fp").over(Window.partitionBy("start", "head", "near"))
    stars = hubs.select("fp", least.alias("least")).where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return found.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """id, text_key, fp, root (a fingerprint that stands for the component) and component_id (the
    least id that links lead to) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_rows")), "classes")
    roots = connected_components(links(classes.select("fp"), bucket_limit)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = label_rows(rooted.select("fp", "root", "n_rows"), least, "root", "n").drop("n")
    return label_rows(rows, named, "fp", "n_rows").select("id", "text_key", "fp", "root", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """One row of ``docs`` per component: that with the least id (null ids last), then text key."""
    labels = near_duplicates(docs, id_col, text_col, words, bucket_limit)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    best = labels.groupBy("root").agg(F.min(rank).alias("best"))
    return keep_rows(docs, best.select("best.id", "best.text_key"), id_col, text_col)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
