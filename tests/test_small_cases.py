"""Functions and files on a few typed rows; the catalogue has the same over whole tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlight import catalog, config
from meterlight.functions import buckets, selection, text
from meterlight.operators import asof, billing, chart, impact, usage
from meterlight.sources import billing_csv, dims
from meterlight.sources.store import Store

DATES = ["2024-01-05", "2024-1-5", "1/5/2024", "13/2/2024", "Jan 5, 2024", "January 5 2024", "2024-01-05 10:00", "2024-01-05T10:00:00Z", "soon", ""]
DAYS = [dt.date(2024, 1, 5)] * 3 + [dt.date(2024, 2, 13)] + [dt.date(2024, 1, 5)] * 4 + [None] * 2
AMOUNTS = [("12.50", 12.5), ("$1,234.00", 1234.0), ("(5)", -5.0), ("($2.5)", -2.5), ("12d", None), ("12f", None), ("1e2", 100.0), ("", None), ("-3", -3.0), (".5", 0.5)]


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}")
    return [r.out for r in rows.select("n", function(F.col("v")).alias("out")).orderBy("n").collect()]


def test_cells(spark):
    assert column(spark, DATES, billing_csv.parse_date) == DAYS
    assert column(spark, [c for c, _ in AMOUNTS], billing_csv.parse_amount) == [v for _, v in AMOUNTS]


def test_units_and_names(spark):
    values = [2.5e6, 1500.0, 2.0, 0.25]
    shown = {
        "ENERGY_UNITS": ["2.50 MWh", "1.50 kWh", "2.00 Wh", "250.00 mWh"], "CARBON_UNITS": ["2.50 t CO₂e", "1.50 kg CO₂e", "2.00 g CO₂e", "250.00 mg CO₂e"],
        "WATER_UNITS": ["2500.00 kL", "1.50 kL", "2.00 L", "250.00 mL"],
    }
    for units, texts in shown.items():
        assert column(spark, values, lambda v, u=units: text.scaled(v, getattr(text, u)), "double") == texts
    assert column(spark, ["input_tokens", "cache_write_1h_tokens", "other"], text.token_type_name) == ["Input", "Cache write 1h", "other"]
    models = spark.createDataFrame([("a-opus-1", 0), ("a-haiku-1", 1), ("a-opus-2", 2), ("z", 3)], "model string, position int")
    assert {(r.model, r.family, r["index"]) for r in chart.palette_index(models).collect()} == {("a-opus-1", "opus", 0), ("a-haiku-1", "haiku", 0), ("a-opus-2", "opus", 1), ("z", "other", 0)}


def test_selections():
    said = [("models", None, 5, "all 5 models"), ("models", 2, 5, "2 of 5 models"), ("projects", 0, 0, "no projects")]
    for plural, chosen, total, words in said:
        assert selection.selection_summary(plural, None if chosen is None else set(map(str, range(chosen))), total) == words
    for parameter, again in [(None, None), ("", None), ("all", None), ("__none__", "__none__"), ("a,b", "a,b"), (",", None)]:
        assert usage.encode_projects(usage.parse_projects(parameter)) == again
    assert [usage.clamp_sessions(k) for k in (None, 7, 9999)] == [25, 7, 500]
    with pytest.raises(ValueError, match="positive"):
        usage.clamp_sessions(0)
    assert [impact.environment_ready(s, s == "placeholder") for s in ("production", "placeholder", "draft")] == [True, False, False]


def test_selection_texts_have_all_cases(spark):
    """Events without a project, what stands for all and none, limits and readiness, too."""
    found = {(r.kind, r.given, r.said) for r in catalog.queries()["selection_texts"](spark, "/root/testdata/sf0.001").collect()}
    wanted = {("models", None, "all 5 models"), ("projects", "0", "0 of 7 projects"), ("projects", None, "all 7 projects"), ("parameter", None, None), ("parameter", "", None)}
    wanted |= {("parameter", "all", None), ("parameter", ",", None), ("parameter", "__none__", "__none__"), ("limit", None, "25"), ("limit", "0", "error"), ("limit", "600", "500")}
    assert wanted | {("ready", "production 0", "true"), ("ready", "production 1", "false"), ("ready", "draft 0", "false")} <= found


def test_subscriptions(spark, tmp_path):
    refused = [(" ", 1.0, "2024-01-01", ""), ("a", -1.0, "2024-01-01", ""), ("a", float("inf"), "2024-01-01", ""), ("a", 1.0, "1/1/2024", ""), ("a", 1.0, "2024-02-01", "2024-01-01")]
    for given in refused:
        with pytest.raises(ValueError):  # noqa: PT011
            billing.validate_subscription(*given)
    assert billing.validate_subscription("a", 0.0, "2024-01-01", "2024-01-01")
    ledger = Store(spark, str(tmp_path))
    for name, price, start in (("Pro", 20.0, "2024-01-01"), ("Max", 100.0, "2024-02-01"), (" Team ", 60.0, "2024-03-01")):
        ledger.insert_subscription(*billing.validate_subscription(name, price, start, ""))
    ledger.update_subscription(1, *billing.validate_subscription("Pro", 25.0, "2024-01-01", "2024-06-30"))
    ledger.delete_subscription(2)
    assert not ledger.update_subscription(9, "x", 1.0, dt.date(2024, 1, 1))
    assert not ledger.delete_subscription(2)
    assert {tuple(r) for r in ledger.subscriptions().collect()} == {(1, "Pro", 25.0, dt.date(2024, 1, 1), dt.date(2024, 6, 30)), (3, "Team", 60.0, dt.date(2024, 3, 1), None)}


PRICES = """schema_version = 1
[providers.anthropic.models.model-b]
display_name = "B"
input_usd_per_mtok = 3
output_usd_per_mtok = 15.0
cache_read_usd_per_mtok = null  # unknown
notes = "x = null"
source_accessed_at = 2024-02-01
[providers.anthropic.models.model-a]
input_usd_per_mtok = 1.0
source_accessed_at = 2024-01-01
"""
FACTORS = """schema_version = 1
file_status = "placeholder"
[defaults]
fallback_pue = 1.2
[providers.anthropic.models.model-a]
wh_per_mtok_input = 5
valid_from = 2024-01-01
[providers.anthropic.models.model-b]
wh_per_mtok_input = null
[grid.us-east-1]
co2e_kg_per_kwh = 0.3
valid_from = 2024-01-03
[grid.eu-west-1]
co2e_kg_per_kwh = 0.2
source_accessed_at = 2024-05-01
"""


def test_files(spark, tmp_path):
    prices = dims.PricingFile(PRICES)
    found = prices.frame(spark).select("model", "display_name", "input_usd_per_mtok", "output_usd_per_mtok", "notes").collect()
    assert [tuple(r) for r in found] == [("model-a", None, 1.0, None, None), ("model-b", "B", 3.0, 15.0, "x = null")]
    assert (prices.most_recent_accessed_at(), prices.needs_review) == (dt.date(2024, 2, 1), False)
    file = dims.FactorsFile(FACTORS)
    snapshot = [
        ("model", "model-a", None, 5.0, dt.date(2024, 1, 1), None), ("model", "model-b", None, None, dt.date(1970, 1, 1), None),
        ("grid", None, "eu-west-1", None, dt.date(1970, 1, 1), dt.date(2024, 5, 1)), ("grid", None, "us-east-1", None, dt.date(2024, 1, 3), dt.date(2024, 1, 3)),
    ]
    shown = ["kind", "model", "region", "wh_per_mtok_input", "valid_from", "source_accessed_at"]
    assert [tuple(r) for r in file.snapshot(spark).select(*shown).collect()] == snapshot
    models = spark.createDataFrame([("model-a",), ("model-x",)], "model string")
    assert {tuple(r) for r in dims.visible_factors(file.snapshot(spark), models, "us-east-1").select(*shown).collect()} == {snapshot[0], snapshot[3]}
    for _ in range(2):
        assert dims.sync_environmental_factors(file, spark, str(tmp_path)) == {"models": 2, "regions": 2, "all_null_models": 1}
    assert (file.most_recent_grid_accessed_at(), file.fallbacks()[0], file.is_placeholder) == (dt.date(2024, 5, 1), 1.2, True)
    assert [spark.read.parquet(f"{tmp_path}/{n}_factors").count() for n in ("env", "grid")] == [2, 2]


def test_configurations():
    default = config.expand(config.DEFAULT_ROOT)
    given = [
        ({"ingest": {"claude_code_roots": []}}, ([default], "us-east-1", 60)),
        ({"ingest": {"claude_code_root": "/one"}, "inference": {"default_inference_region": "eu-west-1"}}, (["/one"], "eu-west-1", 60)),
        ({"ingest": {"claude_code_roots": ["/a", "/b"], "claude_code_root": "/one", "scan_interval_seconds": 0}}, (["/a", "/b"], "us-east-1", 0)),
    ]
    for values, expected in given:
        c = config._fill(config.Config(), values, "")
        assert (c.roots, c.region, c.ingest.scan_interval_seconds) == expected


def test_windows(spark):
    for days in (0, 120, 121, 730, 731):
        assert spark.range(1).select(buckets.granularity_for(F.lit(days))).first()[0] == buckets.auto_granularity(days)
    today = dt.date(2024, 3, 1)
    for preset in (*buckets.RANGE_DAYS, "all"):
        assert spark.range(1).select(buckets.window_start(F.lit(today), preset)).first()[0] == buckets.preset_window(preset, today)[0]
    assert spark.range(1).select(buckets.window_start(F.lit(today))).first()[0] == buckets.resolve_window(None, "", today)[0]


def test_lookups_of_one_day(spark):
    rows = [("p", "m", dt.date(2024, 1, d), None, float(d)) for d in (1, 15)]
    factors = spark.createDataFrame(rows, "provider string, model string, valid_from date, valid_to date, rate double")
    assert asof.lookup_environmental_factors(factors, "p", "m", "2024-01-14").first().rate == 1.0
    assert asof.lookup_environmental_factors(factors, "p", "m", "2023-12-31").count() == 0
    grids = factors.select(F.col("model").alias("region"), "valid_from", F.lit("2024-01-20").cast("date").alias("valid_to"), "rate")
    assert asof.lookup_grid_factors(grids, "m", "2024-01-19").first().rate == 15.0
    assert asof.lookup_grid_factors(grids, "m", "2024-01-20").count() == 0
