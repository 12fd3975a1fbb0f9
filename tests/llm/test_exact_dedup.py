import hashlib

from meterlight.llm.exact_dedup import DigestIndex, distinct_documents

ROWS = [(1, "a"), (2, "b"), (5, "a"), (3, None), (4, ""), (None, "b"), (None, "c"), (7, "d"), (7, "d"), (8, "A"), (9, "a "), (6, "x" * 300_000), (10, "x" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "kept", i) for i, t in rows], "doc_id bigint, text string, digest string, row bigint")


def brute(rows):
    """id, keep_id, group_size, kept, digest of every row, equal texts being one group."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        one = ids.index(best)
        out += [(i, best, len(ids), k == one, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()), key=str)


def test_batches(spark):
    index = DigestIndex(spark, buckets=3)
    assert found(index.add(frame(spark, ROWS))) == brute(ROWS)
    size = index.read().count()
    assert size == len({t or "" for _, t in ROWS})
    later = [(100, "a"), (101, "new"), (102, "new"), (103, None)]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame(spark, later)).collect()}
    assert got == {100: (5, 1, False), 101: (102, 2, False), 102: (102, 2, True), 103: (4, 1, False)}
    assert index.read().count() == size + 1
    assert index.add(frame(spark, ROWS).where("false")).count() == 0
    assert index.read().count() == size + 1


def test_distinct_documents(spark):
    columns = "doc_id bigint, text string, key string, id string, no_id string, n string, row string"
    docs = spark.createDataFrame([(i, t, "k", "i", "o", "n", "r") for i, t in ROWS], columns)
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 2), (False, 4), (False, 5), (False, 7), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert {(r.key, r.id, r.no_id, r.n, r.row) for r in rows} == {("k", "i", "o", "n", "r")}
    assert distinct_documents(docs.where("false")).count() == 0


def test_a_batch_that_is_tried_again_keeps_its_rows(spark):
    index = DigestIndex(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "b")], "doc_id bigint, text string")

    def kept(batch, rows):
        found = index.add(rows, batch=batch).where("kept").select("id").collect()
        return sorted((r.id for r in found), key=lambda i: (i is None, i))

    assert kept("first", docs) == [2, 3, None]
    assert kept("first", docs.repartition(3)) == [2, 3, None]
    assert kept("second", docs) == []
    assert index.read().count() == 3
