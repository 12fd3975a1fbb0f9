import random

import pytest

from meterlight.llm import simhash
from meterlight.llm.components import connected_components


def brute_components(fps, distance=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def brute_fingerprint(text, words=3):
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c d a b c", "É é x y z " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("it is so",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == simhash.fingerprint("it is so")


@pytest.mark.parametrize("limit", [1, 2, 3, 256])
def test_links_reach_every_close_pair(spark, limit):
    rng = random.Random(limit)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(10):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), limit)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    for u, v in [(r.u, r.v) for r in edges.collect()]:
        assert ((u ^ v) % (1 << 64)).bit_count() <= 2
    groups = {}
    for f, r in zip(signed, brute_components(fps), strict=True):
        groups.setdefault(r, set()).add(f)
    expected = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert got == expected


def test_long_path(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "x ")
    rows = [(1, base, 1), (2, near, 2), (3, base, 3), (4, None, 4), (5, "", 5), (None, "other words here", 6), (7, "other words here", 7), (7, "other words here", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r.id is None, r.id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None) for r in roots}
    assert got == sorted((row[0] is None, row[0], least[r]) for row, r in zip(rows, roots, strict=True))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
