"""The pipeline against the same decisions made one after another in plain Python."""

import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from meterlight.llm import bpe, language_id

from .test_decontaminate import brute as contaminated
from .test_near_dup import components

SOURCE = "/root/testdata/sf0.001"


def write(folder, rows):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("key", pa.string())])
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema), folder / "documents.parquet")
    pq.write_table(pq.read_table(f"{SOURCE}/benchmark.parquet"), folder / "benchmark.parquet")


def test_against_plain_python(spark, tmp_path):
    table = pq.read_table(f"{SOURCE}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()
    rows = [(*r.values(), "k") for r in table]
    more = [(9001, None), (9002, ""), (9003, "12 34 !!"), (None, table[0]["text"]), (9004, table[1]["text"]), (9005, table[1]["text"]), (9005, table[1]["text"]), (9006, (table[2]["text"] or "a b") * 300)]
    rows += [(i, t, None, None, None, None) for i, t in more]
    write(tmp_path, rows)
    got = sorted(((r.doc_id, r.key, tuple(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    docs = [(r[0], r[1], r[5]) for r in rows]
    frame = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id bigint, text string, lang string")
    scorer = language_id.Scorer(language_id.fit(frame))
    docs = [d for d, p in zip(docs, scorer.predict([t for _, t, _ in docs]), strict=True) if not p[3]]
    order = lambda d: (d[0] is not None, d[0] or 0)
    latest = {}
    for d in docs:
        if d[1] not in latest or order(d) > order(latest[d[1]]):
            latest[d[1]] = d
    docs = list(latest.values())
    roots = components([t for _, t, _ in docs])
    first = {}
    for d, r in zip(docs, roots, strict=True):
        if r not in first or (d[0] is None, d[0] or 0) < (first[r][0] is None, first[r][0] or 0):
            first[r] = d
    docs = list(first.values())
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SOURCE}/benchmark.parquet").to_pylist()]
    bad = {d for d, _ in contaminated([(i, t) for i, t, _ in docs], items)}
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kept = [d for k, d in enumerate(docs) if k not in bad]
    expected = sorted(((i, key, tuple(ids := library.encode_ordinary(t)), len(ids)) for i, t, key in kept), key=str)
    assert got == expected
    assert 0 < len(bad) < len(docs) < len(rows)


def test_empty_table(spark, tmp_path):
    write(tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_last_stage_decodes(spark):
    texts = ["Größe 12,5\n\tété 日本 🙂", "", None, "a" * 3000, "\ud83d broken".encode("utf-8", "replace").decode()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert [r.round_trip for r in got] == [True] * len(texts)


def test_tasks_have_one_python_worker_and_small_batches(spark):
    """A stage with two workers for each task, and batches of 10,000 texts, took more than an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    try:
        docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('two words ', 200) AS text")
        coded = corpus_pipeline.encode_tokens(spark, docs, "")
        assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        found = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
        assert len(found) > 1 and max(found) < 2 << 20
        spark.conf.set(name, "64k")  # what is smaller already stays
        corpus_pipeline.encode_tokens(spark, docs, "")
        assert spark.conf.get(name) == "64k"
    finally:
        spark.conf.set(name, before)
