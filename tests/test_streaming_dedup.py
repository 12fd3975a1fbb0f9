import datetime as dt

import pytest

from meterlight.schemas import EVENTS
from meterlight.sources.store import Store
from meterlight.streaming import dedup


def event(request, minute, tokens=1, source="api", content_hash=None):
    return (source, dt.datetime(2026, 4, 20, 0, minute, tzinfo=dt.timezone.utc), "m", tokens, 0, 0, 0, 0, request, content_hash, None, None, None, None, None)


@pytest.fixture
def stream(spark, tmp_path):
    folder, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/store", buckets=4)

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = dedup.stream_once(source, store, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return query

    return store, run


def tokens(store):
    return sorted((r.request_id or "", r.input_tokens) for r in store.events().collect())


def test_keys_are_kept_over_restarts(stream):
    store, run = stream
    store.insert_events(store.spark.createDataFrame([event("old", 0, 7)], EVENTS), ["occurred_at"])
    run([event("a", 5, 2), event("a", 3, 1), event("a", 4, 3), event("old", 1, 9), event(None, 1, 4), event(None, 1, 4), event("a", 9, 8, source="other")])
    run([event("a", 1, 5), event("b", 1, 6), event("old", 1, 9)])
    query = run([event("b", 0, 5), event("c", 2, 1), event(None, 1, 4)])
    assert tokens(store) == [("", 4), ("", 4), ("", 4), ("a", 1), ("a", 8), ("b", 6), ("c", 1), ("old", 7)]
    (state,) = query.lastProgress["stateOperators"]
    assert any(name.startswith("rocksdb") for name in state["customMetrics"])
    # later inserts know the stream's keys
    assert store.insert_events(store.spark.createDataFrame([event("c", 3), event("d", 3)], EVENTS), ["occurred_at"]) == {"inserted": 1, "skipped_duplicate": 1}


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([event("a", 1), event("b", 2)], EVENTS)
    assert [store.append_events(rows, "s", n) for n in (0, 0, 1)] == [2, 0, 2]
    assert store.append_events(rows, "other", 0) == 2
    assert store.events().count() == 6


def test_keys_are_kept_without_python(stream):
    """The state is an aggregate's, so that a key costs microseconds; of one micro-batch's rows the first in order wins, nulls first."""
    store, run = stream
    query = run([event("a", 2, 9), event("a", 1, 5), event("b", 1, 1), ("api", None, *event("b", 0, 7)[2:])] + [event(f"k{k}", 1) for k in range(200)])
    (state,) = query.lastProgress["stateOperators"]
    assert state["operatorName"] == "stateStoreSave"
    assert [t for t in tokens(store) if t[0] in "ab"] == [("a", 5), ("b", 7)]
    run([event("a", 0, 6), event("k7", 0, 8), event("z", 1, 2)])
    assert [t for t in tokens(store) if t[0] in ("a", "k7", "z")] == [("a", 5), ("k7", 1), ("z", 2)]
