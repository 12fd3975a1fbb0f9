import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from meterlight.operators import usage
from meterlight.schemas import EVENTS
from meterlight.sources import session_logs, store
from meterlight.sources.manifest import Conflict
from meterlight.sources.store import Store
from meterlight.streaming import ingest


def events(spark, low, high, source="api", partitions=4):
    """Events with the request ids low to high - 1."""
    none = F.lit(None).cast("string")
    made = spark.range(low, high, numPartitions=partitions).select(
        F.lit(source).alias("source"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5 * 86_400).alias("occurred_at"), F.lit("m").alias("model"),
        *[F.lit(1).cast("bigint").alias(f.name) for f in EVENTS[3:8]], F.concat(F.lit("r"), "id").alias("request_id"),
        *[none.alias(f.name) for f in EVENTS[9:]],
    )
    return made


@pytest.fixture
def ledger(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def scans(monkeypatch):
    """The physical plans by which inserts compare batches with the index."""
    found, before = [], Store._append

    def spy(self, rows):
        found.append(plan(rows))
        return before(self, rows)

    monkeypatch.setattr(Store, "_append", spy)
    return found


def test_a_small_batch_reads_only_the_index(spark, ledger, scans):
    assert ledger.insert_events(events(spark, 0, 100_000), ["occurred_at"]) == {"inserted": 100_000, "skipped_duplicate": 0}
    assert ledger.insert_events(events(spark, 99_500, 100_500), ["occurred_at"]) == {"inserted": 500, "skipped_duplicate": 500}
    used = scans[-1]
    read = [line for line in used.splitlines() if "FileScan" in line]
    assert read
    assert all("ReadSchema: struct<key:string>" in line for line in read)  # the index has this column, events have none such
    assert "BroadcastHashJoin" in used
    assert "SortMergeJoin" not in used  # the index is neither sorted nor shuffled


def test_a_large_batch_is_dealt_to_the_buckets(spark, ledger, scans, monkeypatch):
    monkeypatch.setattr(store, "SMALL", 100)
    monkeypatch.setattr(store, "FAN", 1000)
    for low in (0, 3000):
        ledger.insert_events(events(spark, low, low + 3000), ["occurred_at"])
    ledger.insert_events(events(spark, 6000, 6050), ["occurred_at"])
    assert sorted(p.level for p in ledger.version().of("keys")) == [0, 1, 1]
    assert ledger.insert_events(events(spark, 2000, 8000), ["occurred_at"]) == {"inserted": 1950, "skipped_duplicate": 4050}
    used = scans[-1]
    index = [line for line in used.splitlines() if "FileScan" in line]
    assert sum("Bucketed: true" in line and "SelectedBucketsCount: 4 out of 4" in line for line in index) == 2
    below = used[used.index("SortMergeJoin") :]
    assert below.count("SortMergeJoin") == 2
    assert below.count("Exchange hashpartitioning(_key") <= 2  # that of the window and that of the batch; none for the index
    assert "Exchange hashpartitioning(key" not in used
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("meterlight_")]


def test_keys_belong_to_sources(spark, ledger):
    for source in ("a", "b/r:x", "a:b"):
        assert ledger.insert_events(events(spark, 0, 10, source), ["occurred_at"])["inserted"] == 10
    both = events(spark, 5, 15, "a").unionByName(events(spark, 5, 15, "c d=%"))
    assert ledger.insert_events(both, ["occurred_at"]) == {"inserted": 15, "skipped_duplicate": 5}
    assert {r.source: r["count"] for r in ledger.events().groupBy("source").count().collect()} == {"a": 15, "b/r:x": 10, "a:b": 10, "c d=%": 10}
    assert ledger.delete_events("c d=%") == 10
    assert ledger.insert_events(both, ["occurred_at"]) == {"inserted": 10, "skipped_duplicate": 10}


def test_readers_see_whole_transactions(spark, ledger, tmp_path):
    reader = Store(spark, ledger.folder)
    ledger.insert_events(events(spark, 0, 10), ["occurred_at"])
    before = reader.events()
    with ledger.transaction():
        assert ledger.delete_events("api") == 10
        assert ledger.events().count() == 0
        assert reader.events().count() == 10
        ledger.insert_events(events(spark, 0, 7), ["occurred_at"])
        assert reader.events().count() == 10
    assert reader.events().count() == 7
    assert before.count() == 10  # who has begun with a version keeps it


def test_a_crash_leaves_the_old_state(spark, ledger, monkeypatch):
    ledger.insert_events(events(spark, 0, 10), ["occurred_at"])
    with pytest.raises(ZeroDivisionError), ledger.transaction():
        ledger.delete_events("api")
        ledger.insert_events(events(spark, 0, 7), ["occurred_at"])
        raise ZeroDivisionError
    assert ledger.events().count() == 10
    # the index did not take up keys of events that never counted
    assert ledger.insert_events(events(spark, 5, 12), ["occurred_at"]) == {"inserted": 2, "skipped_duplicate": 5}
    assert ledger.vacuum(grace_seconds=3600) == 0  # another writer may still be at work on what no version lists
    assert ledger.vacuum(keep=1, grace_seconds=-60) == 3  # events, keys and totals of the crash
    assert ledger.events().count() == 12


def test_a_crash_during_a_rebuild(spark, ledger, tmp_path, monkeypatch):
    folder = tmp_path / "logs/p"
    folder.mkdir(parents=True)
    line = {"type": "assistant", "timestamp": "2026-04-20T10:00:00Z", "requestId": "r", "message": {"model": "m", "usage": {"input_tokens": 1}}}
    (folder / "a.jsonl").write_text(json.dumps(line) + "\n")
    roots = [str(tmp_path / "logs")]
    assert ingest.scan(spark, ledger, roots)["events_inserted"] == 1

    def fails(*_):
        raise OSError("full")

    with monkeypatch.context() as m:
        m.setattr(Store, "upsert_file_state", fails)
        with pytest.raises(OSError, match="full"):
            ingest.scan(spark, ledger, roots, rebuild=True)
    assert ledger.events().count() == 1
    assert ingest.scan(spark, ledger, roots)["files_unchanged"] == 1
    assert not os.listdir(tmp_path / "store/staging")


def test_two_writers(spark, ledger, monkeypatch):
    other, before, raced = Store(spark, ledger.folder, buckets=4), Store._append, []

    def slow(self, rows):
        if self is ledger and not raced:
            raced.append(other.insert_events(events(spark, 5, 15), ["occurred_at"])["inserted"])
        return before(self, rows)

    monkeypatch.setattr(Store, "_append", slow)
    assert ledger.insert_events(events(spark, 0, 10), ["occurred_at"]) == {"inserted": 5, "skipped_duplicate": 5}
    assert raced == [10]
    assert ledger.events().select("request_id").distinct().count() == ledger.events().count() == 15
    with pytest.raises(Conflict), ledger.transaction():
        ledger.delete_events("api")
        other.insert_subscription("Pro", 1.0, dt.date(2024, 1, 1))
    assert ledger.events().count() == 15


def test_commits_at_once(spark, ledger):
    """Of many writers of one version exactly one wins."""
    start, won = ledger.version(), []

    def write():
        try:
            won.append(ledger.versions.commit(start).number)
        except Conflict:
            pass

    threads = [threading.Thread(target=write) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(won) == {1}
    assert ledger.versions.numbers() == [1]


def test_many_writes_leave_few_parts(spark, ledger):
    at = dt.datetime(2026, 4, 20, tzinfo=dt.timezone.utc)
    for k in range(12):
        rows = [("api", f"/p/{k % 4}", k, k, at + dt.timedelta(minutes=k)), ("api", "/q", k, 1, at + dt.timedelta(minutes=k))]
        ledger.upsert_file_state(spark.createDataFrame(rows, "source string, file_path string, mtime_ns bigint, len bigint, last_scanned_at timestamp"))
        ledger.insert_events(events(spark, 10 * k, 10 * k + 15, partitions=1), ["occurred_at"])
        ledger.compact(fan=3)
    for table in ("events", "keys", "file_state"):
        parts = ledger.version().of(table)
        assert len(parts) <= 2 * 3  # fan - 1 on each of log3(12) levels
    assert {r.file_path: r.mtime_ns for r in ledger.file_state().collect()} == {"/p/0": 8, "/p/1": 9, "/p/2": 10, "/p/3": 11, "/q": 11}
    assert sum(p.rows for p in ledger.version().of("file_state")) < 24
    assert ledger.events().select("request_id").distinct().count() == ledger.events().count() == 125
    assert ledger.insert_events(events(spark, 0, 130), ["occurred_at"])["inserted"] == 5
    ledger.vacuum(keep=1, grace_seconds=-60)
    folder = ledger.folder.removeprefix("file://")
    assert len(os.listdir(f"{folder}/events")) == len(ledger.version().of("events"))
    assert ledger.events().count() == 130


def test_subscriptions_are_merged(spark, ledger):
    ids = [ledger.insert_subscription(f"p{k}", 1.0 + k, dt.date(2024, 1, 1)) for k in range(4)]
    ledger.delete_subscription(ids[1])
    ledger.update_subscription(ids[2], "new", 9.0, dt.date(2024, 1, 1))
    before = sorted(map(tuple, ledger.subscriptions().collect()))
    assert ledger.compact(fan=2) > 0
    assert sorted(map(tuple, ledger.subscriptions().collect())) == before
    assert not ledger.update_subscription(ids[1], "back", 1.0, dt.date(2024, 1, 1))
    assert ledger.insert_subscription("p9", 1.0, dt.date(2024, 1, 1)) == max(ids) + 1


# Logs that are read in byte ranges


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "logs/p"
    folder.mkdir(parents=True)
    line = lambda k: json.dumps({"type": "assistant", "timestamp": "2026-04-20T10:00:00Z", "requestId": f"r{k % 3000}", "message": {"model": "m", "usage": {"input_tokens": k}}})
    lines = [line(k) if k % 7 else "é" * (k % 50) for k in range(6001)]
    (folder / "a.jsonl").write_bytes("\r\n".join(lines).encode())  # no line end at the end
    (folder / "b.jsonl").write_text("x\n\ny\n")
    (folder / "empty +%.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        paths = [r.file_path for r in session_logs.list_files(spark, [str(tmp_path / "logs")]).collect()]
        pieces = session_logs.read_pieces(spark, paths)
        assert pieces.rdd.getNumPartitions() > 10
        assert pieces.where("file_path like '%a.jsonl'").select("block").distinct().count() > 10
        found = session_logs.read_lines(spark, paths).orderBy("file_path", "line_number").collect()
        assert [(r.line_number, r.raw) for r in found if r.file_path.endswith("a.jsonl")] == list(enumerate(lines))
        assert [(r.line_number, r.raw) for r in found if r.file_path.endswith("b.jsonl")] == [(0, "x"), (1, ""), (2, "y")]
        ledger = Store(spark, f"file://{tmp_path}/store", buckets=4)
        counts = ingest.scan(spark, ledger, [str(tmp_path / "logs")])
        assert (counts["files_parsed"], counts["lines_malformed"] + counts["lines_skipped"], counts["events_inserted"] + counts["events_duplicate"]) == (3, 858 + 3, 5143)
        assert ingest.scan(spark, ledger, [str(tmp_path / "logs")])["files_unchanged"] == 3
        first = {}
        for k in range(6001):
            if k % 7:
                first.setdefault(f"r{k % 3000}", k)
        assert {r.request_id: r.input_tokens for r in ledger.events().collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_break_off_count_as_unchanged(spark, tmp_path):
    files = spark.createDataFrame([("whole", 4), ("no end", 3), ("short", 9), ("empty", 0), ("gone", 5), ("bad", 4)], "file_path string, len bigint")
    pieces = spark.createDataFrame(
        [("whole", 2, True), ("whole", 2, True), ("no end", 4, True), ("short", 8, True), ("bad", 2, True), ("bad", 2, False)], "file_path string, n_bytes bigint, valid boolean"
    )
    assert {r.file_path for r in session_logs.whole_files(files, pieces).collect()} == {"whole", "no end", "empty"}


def test_listing(spark, tmp_path):
    root = tmp_path / "a (b)+%[c]"
    for name in ("p x", "_q", "k=v"):
        (root / name / "k=w").mkdir(parents=True)
        (root / name / "1 +%.jsonl").write_text('{"type":"user"}\n')
        (root / name / "k=w/deep.jsonl").write_text("{}")
    found = session_logs.list_files(spark, [str(root)]).collect()
    assert [r.file_path.removeprefix(f"file:{root}/") for r in found] == ["_q/1 +%.jsonl", "k=v/1 +%.jsonl", "p x/1 +%.jsonl"]
    assert all(r.len == 16 and r.mtime_ns == os.stat(r.file_path.removeprefix("file:")).st_mtime_ns // 10**6 * 10**6 for r in found)
    counts = ingest.scan(spark, Store(spark, f"file://{tmp_path}/store"), [str(root)])
    assert (counts["files_seen"], counts["files_parsed"], counts["lines_skipped"]) == (3, 3, 3)


def test_refused_files_are_left_out(spark, tmp_path, monkeypatch):
    folder = tmp_path / "logs/p"
    folder.mkdir(parents=True)
    for name in ("a", "b"):
        (folder / f"{name}.jsonl").write_text('{"type":"user"}\n')
    before, asked = ingest.parse_lines, []

    def refused(*given):
        asked.append(given)
        if len(asked) == 1:
            raise RuntimeError("org.apache.hadoop.security.AccessControlException: Permission denied")
        return before(*given)

    monkeypatch.setattr(ingest, "parse_lines", refused)
    monkeypatch.setattr(ingest, "readable", lambda _, paths: [p for p in paths if p.endswith("a.jsonl")])
    counts = ingest.scan(spark, Store(spark, f"file://{tmp_path}/store"), [str(tmp_path / "logs")])
    assert (counts["files_seen"], counts["files_parsed"], counts["files_unchanged"]) == (2, 1, 1)


# Daily totals


def test_late_rows_change_only_their_days(spark, ledger):
    on = lambda *days: [p.rows for p in ledger.version().of("totals")] and sorted(r.occurred_at.day for r in ledger._load("totals", ledger.version().of("totals")[-1:], store.TOTALS).collect()) == sorted(days)
    ledger.insert_events(events(spark, 0, 100), ["occurred_at"])
    assert on(14, 15, 16, 17, 18)
    ledger.insert_events(events(spark, 100, 130).where(F.col("occurred_at") < "2023-11-16"), ["occurred_at"])
    assert on(14, 15)
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert rows(ledger.totals()) == rows(store.daily_totals(ledger.events()))
    assert {r.occurred_at.day: r.events_count for r in ledger.totals().collect()} == {14: 26, 15: 26, 16: 20, 17: 20, 18: 20}
    before = rows(ledger.totals())
    assert ledger.compact(fan=2) > 0
    assert len(ledger.version().of("totals")) == 1
    assert rows(ledger.totals()) == before
    ledger.insert_events(events(spark, 0, 5, source="b"), ["occurred_at"])
    ledger.delete_events("api")
    assert rows(ledger.totals()) == rows(store.daily_totals(ledger.events()))
    assert ledger.totals().agg(F.sum("events_count")).first()[0] == 5


@pytest.mark.parametrize("limit", [1, 40])
def test_recent_sessions_read_the_latest_days(spark, ledger, limit):
    made = events(spark, 0, 600).withColumns({
        "occurred_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("occurred_at").cast("long") % 7 + F.substring("request_id", 2, 9).cast("long") * 20_000),
        "session_id": F.when(F.col("request_id") != "r599", F.concat(F.lit("s"), (F.substring("request_id", 2, 9).cast("int") % 150).cast("string"))),
        "project_id": F.when(F.col("request_id") > "r3", F.lit("p")),
    })
    ledger.insert_events(made, ["occurred_at"])
    found = usage.recent_sessions_by_day(ledger.events(), ledger.totals(), limit)
    assert found.collect() == usage.recent_sessions(ledger.events(), limit).collect()
    if limit == 1:
        assert "PartitionFilters: [isnotnull(event_date" in plan(found)
    assert usage.recent_sessions_by_day(ledger.events().limit(0), ledger.totals().limit(0)).count() == 0
