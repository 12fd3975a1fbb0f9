import math
import random
import re
from collections import Counter

import duckdb
import pytest

from meterlight.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=50):
    counted = [(id, Counter(terms(text))) for id, text in docs]
    counted = [(id, c, c.total()) for id, c in counted if c]
    n, length = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in items:
        scored = []
        for id, c, size in counted:
            m = 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & set(c))
            if score > 0:
                scored.append((-score, id is None, id))
        found += [(item, rank, id, -s) for rank, (s, _, id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return found


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def ranked(spark, docs, items, **given):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item string, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, terms string")
    return [tuple(r) for r in lexical_search.search(frame, asked, **given).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("segment,tiers,block", [(1 << 21, (32, 512), 500_000), (40, (1, 2), 30), (300, (2, 8), 500_000)])
def test_random_documents(spark, monkeypatch, segment, tiers, block):
    monkeypatch.setattr(lexical_search, "TIERS", tiers)
    monkeypatch.setattr(lexical_search, "PROBE", 1)
    rng = random.Random(segment)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(k // 2, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(12)]
    for k in (50, 3):
        assert by_text(ranked(spark, docs, items, k=k, segment=segment, block=block)) == by_text(brute_force(docs, items, k))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- ..\n"), (None, "Éa B-b"), (5, "éa b_b"), (5, "b B b"), (6, "\x7fb\x00zz Éa"), (7, "zz " * 3000), (None, "b B b")]
    items = [(1, None), (2, ""), (None, "ÉA b"), (3, "B b Éa unknown"), (3, "B b Éa unknown"), (4, "unknown"), (5, "zz b zz")]
    assert by_text(ranked(spark, docs, items)) == by_text(brute_force(docs, items))
    assert ranked(spark, [], items) == []
    assert ranked(spark, docs, []) == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 3)
    assert [t for piece in lexical_search.terms(b"Ab, cdefgh ..i\xc3\xa9\x85 j") for t in piece] == [b"ab", b"cdefgh", b"i\xc3\xa9\x85", b"j"]


def test_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    found = by_text(tuple(r) for r in lexical_search.op11_lexical_search(spark, folder).collect())
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert found == by_text(db.execute(lexical_search.ORACLE_SQL).fetchall())
    rows = lambda name, id: [(r[id], r.text) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
    assert found == by_text(brute_force(rows("documents", "doc_id"), rows("benchmark", "item_id")))


def test_tiers_prove_results():
    """Items are finished without the lower tiers where their bounds allow it."""
    segment = lexical_search._Segment()
    for k in range(2000):
        segment.add(k, Counter({b"a": 50 if k < 5 else 1, b"pad": 100}))
    row = segment.columns(2000, sum(segment.lengths))
    block = lexical_search._Block([])
    block.numbers[b"a"]
    block.weights = [10]
    reader = lexical_search._Reader(row, block, 3)
    reader.lists[1] = reader.lists[2] = None  # any use of them would fail
    docs, _ = reader.search([0], int(sorted(reader.partial([0]))[-5]))
    assert docs.tolist() == [0, 1, 2, 3, 4]
