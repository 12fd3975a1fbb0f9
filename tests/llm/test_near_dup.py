import random

import pytest

import corpus_pipeline
from meterlight.llm import near_dup


def similarity(a, b):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def components(texts):
    roots = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if roots[i] != roots[j] and similarity(texts[i], texts[j]) >= 0.8:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def planted(rng, groups, copies, edits):
    """Texts of 200 words, each with copies in which a few words are exchanged."""
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(copies):
            near = list(base)
            for k in rng.sample(range(200), rng.randint(1, edits)):
                near[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    return texts


@pytest.mark.parametrize(("limit", "groups", "copies", "edits"), [(near_dup.BUCKET_LIMIT, 20, 2, 4), (2, 3, 20, 9)])
def test_stage_finds_planted_near_copies(spark, limit, groups, copies, edits):
    texts = planted(random.Random(limit), groups, copies, edits)
    texts += ["", " \n", None, "one two", "ONE  two", "one two three", texts[0].upper()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, root int")
    kept = near_dup.drop_near_duplicates(docs, bucket_limit=limit)
    assert kept.columns == docs.columns
    expected = sorted(set(components(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == expected
    if limit == near_dup.BUCKET_LIMIT:
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == expected
        assert len(expected) == groups + 3  # each planted group is one class


@pytest.mark.parametrize(("limit", "rounds"), [(1, 3), (3, 3), (1, 0), (3, 1)])
def test_no_pair_of_a_bucket_is_lost(spark, limit, rounds):
    """A chain: each set is near the next, but not the one after it."""
    rows = [(i, list(range(10 * i, 10 * i + 90))) for i in range(6)]  # 80 of 100: exactly 0.8
    sets = spark.createDataFrame(rows, "node bigint, shingles array<bigint>")
    members = spark.createDataFrame([(7, i) for i, _ in rows] + [(8, 3)], "bucket bigint, node bigint")
    edges, roots = near_dup.links(members, sets, bucket_limit=limit, rounds=rounds, pivots=1)
    roots = roots.collect()
    assert len(roots) == len(rows)
    assert {r.node: r.root for r in roots} == {i: 0 for i, _ in rows}
    assert all(abs(r.u - r.v) == 1 for r in edges.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dup.drop_near_duplicates(docs).count() == 0
