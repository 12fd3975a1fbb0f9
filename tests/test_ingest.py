import datetime as dt
import json
import os

import pytest

from meterlight.schemas import EVENTS
from meterlight.sources import dims, session_logs
from meterlight.sources.store import Store
from meterlight.streaming import ingest


def reply(request=None, at="2026-04-20T10:00:00.123Z", model="claude-opus-4-7", **usage):
    line = {"type": "assistant", "timestamp": at, "sessionId": "s", "cwd": "/p", "uuid": "x", "message": {"model": model, "usage": usage}}
    return json.dumps(line | ({"requestId": request} if request else {}))


SESSION = [
    '{"type":"queue-operation","operation":"enqueue"}',
    '{"type":"user","message":{"content":"hi"}}',
    reply("req_1", input_tokens=3, output_tokens=7),
    reply("req_1", input_tokens=3, output_tokens=99),
    reply("req_2", input_tokens=1, cache_creation_input_tokens=999, cache_creation={"ephemeral_5m_input_tokens": 120, "ephemeral_1h_input_tokens": 60}),
    '{"type":"file-history-snapshot"}',
    reply(input_tokens=0, output_tokens=0),
    "not json at all",
    reply("req_3", cache_creation_input_tokens=200),
    '{"type":"ai-title","title":"t"}',
]


@pytest.fixture
def root(tmp_path):
    (tmp_path / "logs/project/deep").mkdir(parents=True)
    (tmp_path / "logs/project/a.jsonl").write_text("\n".join(SESSION) + "\n")
    (tmp_path / "logs/direct.jsonl").write_text(reply("no"))
    (tmp_path / "logs/project/b.JSONL").write_text(reply("no"))
    (tmp_path / "logs/project/deep/c.jsonl").write_text(reply("no"))
    return tmp_path / "logs"


def counters(found):
    return [found[k] for k in ("files_seen", "files_parsed", "lines_skipped", "lines_malformed", "events_inserted", "events_duplicate")]


def test_scan(spark, tmp_path, root):
    store, path = Store(spark, f"file://{tmp_path}/store"), root / "project/a.jsonl"
    scan = lambda **o: counters(ingest.scan(spark, store, [f"file://{root}"], **o))
    assert scan() == [1, 1, 4, 1, 4, 1]
    assert scan() == [1, 0, 0, 0, 0, 0]
    os.utime(path, (1, 1))
    assert scan() == [1, 1, 4, 1, 0, 5]
    with path.open("a") as file:
        file.write(reply("req_4", output_tokens=1) + "\n")
    assert scan() == [1, 1, 4, 1, 1, 5]
    assert scan(rescan=True)[4:] == [0, 6]
    assert scan(rebuild=True)[4:] == [5, 1]
    events = {r.request_id: r for r in store.events().collect()}
    assert events["req_1"].output_tokens == 7  # the first of a key stays
    assert (events["req_2"].cache_write_5m_tokens, events["req_2"].cache_write_1h_tokens) == (120, 60)
    assert (events["req_3"].cache_write_5m_tokens, events["req_3"].cache_write_1h_tokens) == (200, 0)
    assert len(events[None].content_hash) == 64
    assert events["req_1"].occurred_at == dt.datetime(2026, 4, 20, 10, 0, 0, 123000)
    assert store.get_file_state("claude_code", f"file:{path}").count() == 1
    assert store.most_recent_scan_at("claude_code").first()[0] is not None
    assert store.most_recent_scan_at("nobody").first()[0] is None


def test_roots(spark, tmp_path, root):
    with pytest.raises(ValueError):
        session_logs.list_files(spark, [])
    with pytest.raises(FileNotFoundError):
        session_logs.list_files(spark, [f"{tmp_path}/missing"])
    assert session_logs.list_files(spark, [f"{tmp_path}/missing", f"{root}"]).count() == 1
    rounds = []
    ingest.scan_forever(spark, Store(spark, f"file://{tmp_path}/s2"), [f"{tmp_path}/missing"], 0.01, rounds=2, log=rounds.append)
    assert len(rounds) == 2


@pytest.mark.parametrize("line,kind", [
    ("", "skip"), ("   ", "skip"), ("{", "malformed"), ("[1]", "malformed"), ('{"a":1}', "malformed"), ('{"type":"user"}', "skip"),
    ('{"type":"assistant"}', "malformed"), (reply("r", at="yesterday"), "malformed"), (reply("r", model=None), "malformed"),
    (reply("r", input_tokens=1.5), "malformed"), (reply("r", input_tokens=-1), "malformed"), (reply("r", input_tokens="3"), "malformed"),
    (reply("r"), "event"), (reply("r", at="2026-04-20T10:00:00+02:00"), "event"), (reply("r", unknown={"a": 1}), "event"),
    ('{"type":"assistant","timestamp":"2026-04-20T10:00:00Z","message":{"model":"m"}}', "event"),
    ('{"type":"assistant","timestamp":"2026-04-20T10:00:00Z","message":{"model":"m","usage":null}}', "malformed"),
])
def test_lines(spark, line, kind):
    assert session_logs.parse_lines(spark.createDataFrame([(line,)], "raw string")).first().kind == kind


def test_rows_without_a_key_are_all_new(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    row = ("api", dt.datetime(2026, 4, 20, tzinfo=dt.timezone.utc), "m", 1, 0, 0, 0, 0, None, None, None, None, None, None, None)
    rows = spark.createDataFrame([row] * 3, EVENTS)
    for _ in range(2):
        assert store.insert_events(rows, ["occurred_at"]) == {"inserted": 3, "skipped_duplicate": 0}
    assert store.events().count() == 6
    assert store.delete_events("api") == 6
    assert store.events().count() == 0


def test_stream(spark, tmp_path):
    rows = [("api", dt.datetime(2026, 4, d, tzinfo=dt.timezone.utc), "m", d, 0, 0, 0, 0, f"r{d}", None, None, None, None, None, None) for d in (20, 21, 26, 27)]
    frame = spark.createDataFrame(rows, EVENTS)
    for _ in range(2):
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.stream_into(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.events().count() == 4
    totals = {r.bucket.isoformat(): r.input_tokens for r in ingest.bucket_totals(store.events(), "week").collect()}
    assert totals == {"2026-04-20": 67, "2026-04-27": 27}


def test_charges_and_subscriptions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    day = dt.date(2026, 4, 1)
    rows = [("csv", day, 20.0, "a", "subscription", "in_1", None), ("csv", day, 20.0, "b", "subscription", "in_1", None), ("csv", day, 5.0, None, "overage", None, None)]
    charges = spark.createDataFrame(rows, "source string, occurred_at date, amount_usd double, description string, category string, external_id string, raw string")
    assert store.insert_charges(charges) == {"inserted": 2, "skipped": 1}
    assert store.insert_charges(charges) == {"inserted": 0, "skipped": 3}
    (made,) = [r.external_id for r in store.charges().where("amount_usd = 5").collect()]
    assert made.startswith("synth:")
    assert len(made) == 38
    first = store.insert_subscription("Pro", 20.0, day)
    second = store.insert_subscription("Max", 100.0, day, dt.date(2026, 5, 1))
    assert store.update_subscription(first, "Pro", 25.0, day)
    assert not store.update_subscription(99, "x", 1.0, day)
    assert {(r.id, r.monthly_usd) for r in store.subscriptions().collect()} == {(first, 25.0), (second, 100.0)}
    assert store.commit_billing(charges, [second, 99]) == {"inserted": 0, "skipped": 3, "subscriptions_deleted": 1}
    assert [r.id for r in store.subscriptions().collect()] == [first]
    assert store.delete_charges("csv") == 2
    assert store.charges().count() == 0


FACTORS = """
schema_version = 1
# wh = null stays
[models.anthropic.sonnet]
valid_from = "2026-01-01"
wh_per_mtok_input = 195
wh_per_mtok_output = null  # unknown
note_with_equals = "a = null"
[models.anthropic.haiku]
wh_per_mtok_input = null
[grid.us-east-1]
pue = 1.15
co2e_kg_per_kwh = null
[defaults]
fallback_pue = 1.15
fallback_wue_l_per_kwh = 0.15
"""


def test_files(spark, tmp_path):
    file = dims.FactorsFile(FACTORS)
    assert (file.file_status, file.is_placeholder, file.fallbacks()) == ("production", False, (1.15, 0.15))
    assert file.counts() == {"models": 2, "regions": 1, "all_null_models": 1}
    rows = {r.model: r for r in file.model_frame(spark).collect()}
    assert (rows["sonnet"].wh_per_mtok_input, rows["sonnet"].wh_per_mtok_output, rows["haiku"].valid_from) == (195.0, None, dt.date(1970, 1, 1))
    (grid,) = file.grid_frame(spark).collect()
    assert (grid.pue, grid.co2e_kg_per_kwh) == (1.15, None)
    assert dims.sync_environmental_factors(file, spark, str(tmp_path))["models"] == 2
    assert spark.read.parquet(f"{tmp_path}/env_factors").count() == 2
    with pytest.raises(dims.UnsupportedVersion):
        dims.FactorsFile("schema_version = 999")
    price = dims.PricingFile('schema_version = 1\nfile_status = "needs_review"\n[models.anthropic.opus]\nvalid_from = 2026-01-01\ninput_usd_per_mtok = 15\nsource_accessed_at = "2026-04-01"\n')
    assert (price.needs_review, price.most_recent_accessed_at(), price.frame(spark).first().input_usd_per_mtok) == (True, dt.date(2026, 4, 1), 15.0)


def test_files_that_are_not_utf8_count_as_unchanged(spark, tmp_path):
    folder = tmp_path / "ro[o]t" / "project"  # a root is a name, not a pattern
    folder.mkdir(parents=True)
    (folder / "good.jsonl").write_text('{"type":"user"}\n')
    (folder / "bad.jsonl").write_bytes(b'{"type":"user"}\n\xff\xfe\n')
    store = Store(spark, f"file://{tmp_path}/store")
    for parsed, unchanged in ((1, 1), (0, 2)):
        found = ingest.scan(spark, store, [str(tmp_path / "ro[o]t")])
        assert (found["files_seen"], found["files_parsed"], found["files_unchanged"]) == (2, parsed, unchanged)
    assert store.file_state().count() == 1
