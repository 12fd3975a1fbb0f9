import datetime as dt

import pytest

from meterlight.operators import chart, usage
from meterlight.schemas import EVENTS

OPUS, SONNET, HAIKU = "claude-opus-4-7", "claude-sonnet-4-6", "claude-haiku-4-5"


def event(at, model, tokens, request=None, project="/p", session="sess1", source="claude_code"):
    when = dt.datetime.fromisoformat(at).replace(tzinfo=dt.timezone.utc)
    return (source, when, model, tokens, 0, 0, 0, 0, request or f"{at}{model}", None, session, project, None, None, None)


SIX = [
    event("2026-04-20T01:00", OPUS, 100), event("2026-04-20T02:00", OPUS, 50), event("2026-04-20T03:00", SONNET, 30),
    event("2026-04-21T01:00", OPUS, 200), event("2026-04-21T02:00", SONNET, 70), event("2026-04-22T01:00", HAIKU, 5),
]
APRIL = ("2026-04-01", "2026-04-30")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("claude_code", "anthropic"), ("admin_api", "anthropic"), ("other", "elsewhere")], "kind string, provider string")


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, EVENTS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_daily(frame, sources):
    got = rows(usage.daily_usage(frame(SIX), sources, *APRIL))
    assert got == [
        ("2026-04-20", OPUS, 150), ("2026-04-20", SONNET, 30), ("2026-04-21", OPUS, 200), ("2026-04-21", SONNET, 70), ("2026-04-22", HAIKU, 5),
    ]


def test_window_ends_are_inclusive(frame, sources):
    more = frame([*SIX, event("2026-04-22T23:59:59.999", OPUS, 1), event("2026-04-23T00:00", OPUS, 1000), event("2026-04-19T23:59:59", OPUS, 1000)])
    assert sum(r[2] for r in rows(usage.daily_usage(more, sources, "2026-04-20", "2026-04-22"))) == 456
    assert rows(usage.daily_usage(more, sources, "2026-04-22", "2026-04-20")) == []


@pytest.mark.parametrize("granularity,expected", [
    ("week", [("2026-04-20", OPUS, 350), ("2026-04-20", SONNET, 100), ("2026-04-20", HAIKU, 5)]),
    ("month", [("2026-04-01", OPUS, 350), ("2026-04-01", SONNET, 100), ("2026-04-01", HAIKU, 5)]),
    ("fortnight", [("2026-04-20", OPUS, 150), ("2026-04-20", SONNET, 30), ("2026-04-21", OPUS, 200), ("2026-04-21", SONNET, 70), ("2026-04-22", HAIKU, 5)]),
])
def test_buckets(frame, sources, granularity, expected):
    got = [(r.bucket, r.model, r.input_tokens) for r in usage.daily_usage_breakdown(frame(SIX), sources, *APRIL, granularity=granularity).collect()]
    assert got == sorted(expected)


def test_week_and_month_borders(frame, sources):
    events = frame([event("2026-04-26T23:00", OPUS, 1), event("2026-04-27T00:00", OPUS, 2), event("2026-05-01T00:00", OPUS, 4)])
    week = usage.daily_usage_breakdown(events, sources, "2026-04-01", "2026-05-31", granularity="week")
    assert [(r.bucket, r.input_tokens) for r in week.collect()] == [("2026-04-20", 1), ("2026-04-27", 6)]
    month = usage.daily_usage_breakdown(events, sources, "2026-04-01", "2026-05-31", granularity="month")
    assert [(r.bucket, r.input_tokens) for r in month.collect()] == [("2026-04-01", 3), ("2026-05-01", 4)]


def test_projects(frame, sources):
    events = frame([event("2026-04-20T01:00", OPUS, 100, "a", "/x"), event("2026-04-20T02:00", OPUS, 200, "b", "/y"), event("2026-04-20T03:00", OPUS, 50, "c", None)])
    total = lambda p: sum(r.input_tokens for r in usage.daily_usage_breakdown(events, sources, *APRIL, projects=usage.parse_projects(p)).collect())
    assert [total(p) for p in (None, "", "all", ",", "/x", "/x,/y,", usage.NO_PROJECT, "/z")] == [350, 350, 350, 350, 100, 300, 0, 0]
    assert rows(usage.list_projects_with_totals(events, sources, *APRIL)) == [("/y", 1, 200), ("/x", 1, 100)]
    # No project is chosen, but the window's models stay listed.
    assert rows(usage.list_models_in_window(events, sources, *APRIL)) == [(OPUS, 350)]
    for p in (None, "/x,/y", usage.NO_PROJECT):
        assert usage.encode_projects(usage.parse_projects(p)) == p


def test_models(frame, sources):
    events = frame([*SIX, event("2026-04-20T05:00", "idle", 0), event("2026-04-20T05:00", "foreign", 9, source="other")])
    assert rows(usage.list_models_in_window(events, sources, *APRIL, "anthropic")) == [(OPUS, 350), (SONNET, 100), (HAIKU, 5)]
    by_model = usage.usage_by_model(events, sources, *APRIL).collect()
    assert (by_model[0].model, by_model[0].events_count, by_model[0].input_tokens) == (OPUS, 3, 350)
    assert by_model[-1].model == "idle"
    assert rows(usage.list_models_in_window(events, sources, *APRIL, "elsewhere")) == [("foreign", 9)]


def test_sessions(frame, sources):
    (only,) = usage.recent_sessions(frame(SIX)).collect()
    assert (only.events_count, only.total_tokens, only.started_at, only.ended_at) == (6, 455, dt.datetime(2026, 4, 20, 1), dt.datetime(2026, 4, 22, 1))
    events = frame([event("2026-04-20T01:00", OPUS, 1, project=None), event("2026-04-20T02:00", OPUS, 1), event("2026-04-20T03:00", OPUS, 1, session=None)])
    assert [r.project_id for r in usage.recent_sessions(events).collect()] == ["/p", None]
    assert [usage.clamp_sessions(n) for n in (None, 1, 500, 501)] == [25, 1, 500, 500]
    with pytest.raises(ValueError):
        usage.clamp_sessions(0)


def test_health(frame, sources):
    (r,) = usage.health_summary(frame(SIX), sources).collect()
    assert (r.events_count, r.providers) == (6, ["anthropic", "elsewhere"])
    assert rows(usage.source_kinds(sources)) == [("admin_api",), ("claude_code",), ("other",)]
    assert usage.count_events(frame([])).first()[0] == 0


def test_charts(frame, sources):
    breakdown = usage.daily_usage_breakdown(frame(SIX), sources, *APRIL, granularity="week")
    by_model = chart.stack_by_model(breakdown, [OPUS, SONNET], "2026-04-20", "2026-05-03", "week").collect()
    assert [(r.bucket.isoformat(), r[OPUS], r[SONNET]) for r in by_model] == [("2026-04-20", 50.0, 100 / 7), ("2026-04-27", 0.0, 0.0)]
    by_type = chart.stack_by_token_type(breakdown, [OPUS], "2026-04-20", "2026-04-22", "week").collect()
    assert [(r.input_tokens, r.output_tokens) for r in by_type] == [(350 / 3, 0.0)]
    assert chart.stack_by_token_type(breakdown, [], "2026-04-20", "2026-04-22", "week").first().input_tokens == 0


def test_scan_gets_the_window_and_the_columns(spark, frame, sources, tmp_path):
    frame(SIX).write.parquet(str(tmp_path / "events"))
    found = usage.daily_usage(spark.read.parquet(str(tmp_path / "events")), sources, *APRIL)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "GreaterThanOrEqual(occurred_at" in plan
    assert "LessThan(occurred_at" in plan
    assert "request_id" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
