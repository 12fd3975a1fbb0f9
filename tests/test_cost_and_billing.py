import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlight.functions import buckets, text
from meterlight.operators import billing, cost
from meterlight.schemas import PRICING, SUBSCRIPTIONS, TOKEN_COLUMNS
from meterlight.sources import billing_csv

OPUS, SONNET = "claude-opus-4-7", "claude-sonnet-4-6"
DATE = dt.date.fromisoformat


@pytest.fixture(scope="module")
def pricing(spark):
    tail = (1.25, 2.0, None, None, None)
    rows = [("anthropic", OPUS, "Opus", DATE("2026-01-01"), 15.0, 75.0, 1.5, *tail), ("anthropic", SONNET, "Sonnet", DATE("2026-01-01"), 3.0, 15.0, 0.3, *tail)]
    return spark.createDataFrame(rows, PRICING)


@pytest.fixture(scope="module")
def cells(spark):
    columns = "bucket string, provider string, model string, " + ", ".join(f"{c} bigint" for c in TOKEN_COLUMNS)
    rows = [("b", OPUS, 1000, 100, 10000, 100, 50), ("b", SONNET, 10, 0, 10000, 1, 0), ("b", "unpriced", 5, 5, 5, 5, 5), ("c", OPUS, 1000, 100, 0, 0, 0)]
    return spark.createDataFrame([(b, "anthropic", *r) for b, *r in rows], columns)


def test_billable(cells, pricing):
    got = {(r.bucket, r.model): r for r in cost.billable_breakdown(cells, pricing).collect()}
    assert got["b", OPUS].billable_total == 2725
    assert got["c", OPUS].billable_total == 1500
    sonnet = got["b", SONNET]  # 0.3 / 3.0 is just below 0.1, and 1.25 is cut
    assert (sonnet.billable_input_tokens, sonnet.billable_cache_read_tokens, sonnet.billable_cache_write_5m_tokens) == (10, 999, 1)
    assert (got["b", "unpriced"].priced, got["b", "unpriced"].billable_total) == (False, None)
    weighted = {(r.bucket, r.model): r.weighted_total for r in cost.weighted_tokens(cells, pricing).collect()}
    assert weighted["b", OPUS] == pytest.approx(2725.0)


def test_costs(cells, pricing):
    found = cost.billable_breakdown(cells, pricing)
    total = (2725 + 1500) * 15 / 1e6 + 1010 * 3 / 1e6
    assert cost.counterfactual_cost(found).first()[0] == pytest.approx(total)
    assert cost.counterfactual_cost(found, [OPUS], ["input_tokens"]).first()[0] == pytest.approx(2000 * 15 / 1e6)
    assert cost.counterfactual_cost(found, []).first()[0] == 0.0
    shares = {r.model: r.cost_share for r in cost.cost_by_model(found).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    assert set(shares) == {OPUS, SONNET}
    r = cost.cache_stats(found).first()
    assert r.cached_fraction == pytest.approx(20005 / (2015 + 20005 + 106 + 55))
    assert r.saved_usd == pytest.approx((10000 * 15 + 10000 * 3) * 0.9 / 1e6)
    none = cost.cache_stats(found.where("false")).first()
    assert (none.cached_fraction, none.saved_usd) == (None, None)


def test_model_lists(cells, pricing):
    assert [r.model for r in cost.models_without_pricing(cells, pricing).collect()] == ["unpriced"]
    kept, dropped = cost.priced_only(cells, pricing)
    assert (kept.count(), [r.model for r in dropped.collect()]) == (3, ["unpriced"])
    assert {tuple(r) for r in cost.pricing_by_model(cells, pricing).collect()} == {(OPUS, 15.0), (SONNET, 3.0)}


CSV = """﻿id,Date,Description,Amount,Currency,Status
in_1,2026-04-01,Claude Max plan subscription,$200.00,usd,paid
in_2,04/05/2026,API usage overage,"$1,234.56",USD,paid
in_3,"Apr 7, 2026",Refund for overage,(50.00),USD,paid
in_4,2026-04-08 10:00:00,One-time setup,10,,paid
in_5,2026-04-09,Etwas,10,EUR,paid
,25/04/2026,Chargeback fee,-3.5,USD,paid
in_7,2026-04-10,"Monthly, with
a line break",£20,USD,paid
"""


def write(folder, body):
    path = folder / "charges.csv"
    path.write_text(body)
    return str(path)


def test_csv(spark, tmp_path):
    got = [(r.external_id, r.occurred_at.isoformat(), r.amount_usd, r.category) for r in billing_csv.read_charges(spark, write(tmp_path, CSV)).orderBy("position").collect()]
    assert got == [
        ("in_1", "2026-04-01", 200.0, "subscription"), ("in_2", "2026-04-05", 1234.56, "overage"), ("in_3", "2026-04-07", -50.0, "refund"),
        ("in_4", "2026-04-08", 10.0, "one_time"), (None, "2026-04-25", -3.5, "refund"), ("in_7", "2026-04-10", 20.0, "subscription"),
    ]


@pytest.mark.parametrize("body,error", [
    ("id,Amount\na,1\n", billing_csv.MissingColumn), ("id,Date\na,2026-01-01\n", billing_csv.MissingColumn),
    ("Date,Amount,Currency\n2026-01-01,1,USD\nnever,1,EUR\n", billing_csv.BadCharge), ("Date,Amount\n2026-01-01,much\n", billing_csv.BadCharge),
])
def test_bad_csv(spark, tmp_path, body, error):
    with pytest.raises(error):
        billing_csv.read_charges(spark, write(tmp_path, body))


def test_header_only(spark, tmp_path):
    assert billing_csv.read_charges(spark, write(tmp_path, "Date,Amount\n")).count() == 0
    assert billing_csv.resolve_columns(["Total", " AMOUNT ", "Created (UTC)"])["amount"] == " AMOUNT "


@pytest.fixture(scope="module")
def charges(spark):
    rows = [
        (1, "csv", DATE("2026-04-10"), 20.0, "Pro plan", "subscription", "in_001", 1), (2, "csv", DATE("2026-04-12"), -5.0, None, "refund", None, 2),
        (3, "csv", DATE("2026-05-10"), 20.004, "Pro plan", "subscription", None, 3), (4, "api", DATE("2026-05-11"), 7.0, "x", "overage", "in_002", 4),
    ]
    return spark.createDataFrame(rows, "id bigint, source string, occurred_at date, amount_usd double, description string, category string, external_id string, position bigint")


def test_ledger(charges):
    total = lambda *a: billing.sum_charges_in_window(charges, *a).first()[0]
    assert (total("2026-04-10", "2026-04-12"), total("2025-01-01", "2025-12-31"), total("2026-05-01", "2026-05-31", "api")) == (15.0, 0.0, 7.0)
    assert [r.id for r in billing.charges_in_window(charges, "2026-04-01", "2026-05-31").collect()] == [4, 3, 2, 1]
    r = billing.charges_by_kind(charges, "2026-04-01", "2026-05-31").first()
    assert (r.subscription_usd, r.other_usd) == (pytest.approx(40.004), 2.0)
    (group,) = billing.imported_subscriptions(charges).collect()
    assert (group.amount_usd, group.n_charges, group.total_usd) == (20.0, 2, pytest.approx(40.004))


def test_conflicts(spark, charges):
    subs = spark.createDataFrame([(1, "Pro", 20.0, DATE("2026-04-10"), None), (2, "Old", 20.0, DATE("2025-01-01"), DATE("2026-04-09")), (3, "Later", 20.0, DATE("2026-05-01"), None)], SUBSCRIPTIONS)
    assert [(r.id, r.external_ids) for r in billing.subscription_conflicts(charges, subs).collect()] == [(1, ["in_001"])]


def test_prorating(spark):
    subs = [(1, "whole", 30.4375, DATE("2020-01-01"), None), (2, "in", 30.4375, DATE("2026-04-10"), DATE("2026-04-10")), (3, "out", 1.0, DATE("2026-05-01"), None)]
    got = {r.id: r.prorated_usd for r in billing.prorated_subscriptions(spark.createDataFrame(subs, SUBSCRIPTIONS), "2026-04-01", "2026-04-30").collect()}
    assert got == {1: pytest.approx(30, abs=1e-6), 2: pytest.approx(1, abs=1e-6)}
    both = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r.c for r in both.select(billing.combine_billed(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 2.0, None, 3.0]


def test_overrides(spark, charges):
    overrides = spark.createDataFrame([("in_001", "one_time"), ("row:2", "overage")], "key string, category string")
    assert {r.id: r.category for r in billing.apply_overrides(charges, overrides).collect()} == {1: "one_time", 2: "overage", 3: "subscription", 4: "overage"}


def test_subscription_validation():
    assert billing.validate_subscription(" Pro ", 20, "2026-01-01", "") == ("Pro", 20, DATE("2026-01-01"), None)
    for bad in (("", 1, "2026-01-01", None), ("a", -1, "2026-01-01", None), ("a", float("nan"), "2026-01-01", None), ("a", 1, "x", None), ("a", 1, "2026-01-02", "2026-01-01")):
        with pytest.raises(ValueError):
            billing.validate_subscription(*bad)


def test_text_functions(spark):
    df = spark.createDataFrame([(OPUS, "/a/b/"), ("gpt", "x" * 41), ("my-sonnet", "/"), ("claude-opus-4", "plain")], "m string, p string")
    got = df.select(text.model_display_name(F.col("m")), text.model_family(F.col("m")), text.project_short_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Claude Opus 4.7", "opus", "b"), ("gpt", "other", "x" * 37 + "…"), ("my-sonnet", "sonnet", "/"), ("claude-opus-4", "opus", "plain")]
    decoded = spark.createDataFrame([("refund",), ("odd",), (None,)], "c string").select(text.decode_category(F.col("c"))).collect()
    assert [r[0] for r in decoded] == ["refund", "unknown", "unknown"]


def test_calendar(spark):
    week = [r.bucket.isoformat() for r in buckets.enumerate_buckets(spark, "2026-04-22", "2026-05-04", "week").collect()]
    assert week == ["2026-04-20", "2026-04-27", "2026-05-04"]
    assert [r.bucket.isoformat() for r in buckets.enumerate_buckets(spark, "2026-04-22", "2026-05-04", "month").collect()] == ["2026-04-01", "2026-05-01"]
    assert buckets.enumerate_buckets(spark, "2026-05-04", "2026-04-22", "day").count() == 0
    days = buckets.enumerate_buckets(spark, "2026-04-22", "2026-05-04", "week").select(buckets.active_days(F.col("bucket"), "week", "2026-04-22", "2026-05-04")).collect()
    assert [r[0] for r in days] == [5, 7, 1]
    assert [buckets.auto_granularity(n) for n in (120, 121, 730, 731)] == ["day", "week", "week", "month"]
    today = DATE("2026-04-30")
    assert buckets.resolve_window(None, None, today) == (DATE("2026-03-31"), today)
    assert buckets.preset_window("7d", today) == (DATE("2026-04-23"), today)
    assert buckets.preset_window("all", today)[0] == DATE("2022-12-01")
    with pytest.raises(ValueError):
        buckets.resolve_window("yesterday", None, today)
