import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlight.functions import maths
from meterlight.operators import asof, impact
from meterlight.schemas import ENV_FACTORS, EVENTS, GRID_FACTORS, TOKEN_COLUMNS

SONNET = "claude-sonnet-4-6"
RATES = dict(zip(impact.WH_COLUMNS, (195.0, 965.0, None, None, None), strict=True))
GRID = {"pue": 1.15, "co2e_kg_per_kwh": 0.270, "water_l_per_kwh": 0.15, "indirect_water_l_per_kwh": None}
BANDS = {"uncertainty_range_pct": 35, "co2e_uncertainty_range_pct": 15, "water_uncertainty_range_pct": 50}


def one(spark, tokens, fallbacks=(None, None), **changes):
    values = {**dict(zip(TOKEN_COLUMNS, tokens, strict=True)), **RATES, **GRID, **BANDS, **changes}
    kinds = {c: "bigint" for c in TOKEN_COLUMNS} | {c: "int" for c in BANDS}
    schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in values)
    return impact.compute_impact(spark.createDataFrame([tuple(values.values())], schema), *fallbacks).first()


MILLION = (1_000_000, 0, 0, 0, 0)
BOTH = (1_000_000, 100_000, 0, 0, 0)


def test_one_row(spark):
    r = one(spark, BOTH)
    assert (r.energy_wh, r.facility_wh, r.co2e_g, r.water_l) == pytest.approx((291.5, 335.225, 90.51075, 0.05028375), abs=1e-9)
    assert (r.co2e_uncertainty_pct, r.water_uncertainty_pct) == (38, 61)
    assert (r.used_fallback_pue, r.used_fallback_wue) == (False, False)


def test_fallbacks(spark):
    r = one(spark, MILLION, (1.15, 0.15), water_l_per_kwh=None)
    assert r.water_l == pytest.approx(0.0336375)
    assert r.used_fallback_wue
    assert one(spark, MILLION, water_l_per_kwh=None).water_l is None
    r = one(spark, MILLION, pue=None)
    assert (r.facility_wh, r.used_fallback_pue) == (195.0, False)
    assert one(spark, MILLION, co2e_kg_per_kwh=None).co2e_g is None
    assert one(spark, BOTH, wh_per_mtok_input=None).energy_wh == pytest.approx(96.5)


def test_uncertainty(spark):
    pairs = {(0, 0): 0, (35, 0): 35, (0, 50): 50, (3, 4): 5, (35, 15): 38, (35, 50): 61}
    df = spark.createDataFrame(list(pairs), "a int, b int")
    assert {(r.a, r.b): r.c for r in df.withColumn("c", maths.combine_uncertainty(F.col("a"), F.col("b"))).collect()} == pairs
    sums = spark.createDataFrame([(3.0, 10, 4.0, 0), (0.0, 7, 0.0, 9)], "a double, u int, b double, v int")
    assert [r.c for r in sums.withColumn("c", maths.combine_sum_uncertainty(*map(F.col, "aubv"))).collect()] == [4, 9]
    band = spark.range(1).select(maths.bracket(F.lit(10.0), F.lit(20)).alias("b"), maths.bracket(F.lit(10.0), F.lit(0)).alias("n")).first()
    assert (band.b.low, band.b.high, band.n) == (8.0, 12.0, None)
    digits = spark.createDataFrame([(4, 12345.0), (14, 12345.0), (15, 12345.0), (3, 0.0)], "p int, v double")
    rounded = maths.round_significant(F.col("v"), maths.significant_digits(F.col("p")))
    assert [r.x for r in digits.withColumn("x", rounded).collect()] == [12350.0, 12300.0, 12000.0, 0.0]


def event(day, tokens=BOTH, model=SONNET, source="claude_code"):
    return (source, dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc), model, *tokens, f"{day}{model}{tokens}", None, "s", "/p", None, None, None)


def factor(valid_from, wh=0.5, model=SONNET, band=35):
    return ("anthropic", model, dt.date.fromisoformat(valid_from), None, wh, 2.0, 0.05, 0.5, 0.5, band, None, "doc", None)


def grid(valid_from="2026-01-01", co2e=0.30, water=0.20, pue=1.15, bands=(None, None, None), region="us-east-1"):
    return (region, dt.date.fromisoformat(valid_from), None, co2e, water, None, pue, *bands, None, None, "url", None)


def aggregate(spark, events, factors, grids, **options):
    sources = spark.createDataFrame([("claude_code", "anthropic")], "kind string, provider string")
    frames = spark.createDataFrame(events, EVENTS), sources, spark.createDataFrame(factors, ENV_FACTORS), spark.createDataFrame(grids, GRID_FACTORS)
    return impact.aggregate_impact_by_bucket(*frames, "2026-01-01", "2026-12-31", **options)


def test_aggregate(spark):
    r = aggregate(spark, [event("2026-04-20T01:00")], [factor("2026-01-01")], [grid()]).first()
    assert (r.energy_wh, r.facility_wh, r.co2e_g, r.water_l, r.indirect_water_l) == (pytest.approx(0.7), pytest.approx(0.805), pytest.approx(0.2415), pytest.approx(0.000161), None)
    assert (r.model_uncertainty_pct, r.co2e_uncertainty_pct, r.events_missing_env_factor, r.events_count) == (35, 35, 0, 1)


def test_missing_factors(spark):
    r = aggregate(spark, [event("2026-04-20T01:00", model="unknown")], [factor("2026-01-01")], [grid()]).first()
    assert (r.energy_wh, r.co2e_g, r.events_missing_env_factor) == (0.0, 0.0, 1)
    r = aggregate(spark, [event("2026-04-20T01:00")], [factor("2026-01-01")], [grid(pue=None, water=None)], fallback_pue=1.2).first()
    assert r.facility_wh == pytest.approx(0.84)
    assert (r.water_l, r.events_using_fallback_pue, r.events_using_fallback_wue) == (None, 1, 1)
    r = aggregate(spark, [event("2026-04-20T01:00")], [factor("2026-01-01")], [grid(region="elsewhere")]).first()
    assert (r.co2e_g, r.water_l) == (None, None)
    r = aggregate(spark, [event("2026-04-20T01:00")], [factor("2026-01-01")], [grid(bands=(15, 50, None))]).first()
    assert (r.co2e_uncertainty_pct, r.water_uncertainty_pct, r.indirect_water_uncertainty_pct) == (38, 61, 35)


VERSIONS = [factor("2026-01-01", 0.5), factor("2026-04-15", 0.7)]


def test_versions(spark):
    factors = spark.createDataFrame(VERSIONS, ENV_FACTORS)
    found = {d: [r.wh_per_mtok_input for r in asof.lookup_environmental_factors(factors, "anthropic", SONNET, d).collect()] for d in ("2026-03-10", "2026-04-15", "2026-04-29", "2025-12-31")}
    assert found == {"2026-03-10": [0.5], "2026-04-15": [0.7], "2026-04-29": [0.7], "2025-12-31": []}
    got = aggregate(spark, [event(f"2026-{d}T00:00", MILLION) for d in ("01-01", "04-14", "04-15", "12-31")], VERSIONS, [grid()]).collect()
    assert [(r.bucket, r.energy_wh) for r in got] == [("2026-01-01", 0.5), ("2026-04-14", 0.5), ("2026-04-15", 0.7), ("2026-12-31", 0.7)]
    with pytest.raises(asof.DuplicateVersions):
        asof.assert_unique_versions(spark.createDataFrame([VERSIONS[0]] * 2, ENV_FACTORS), ["provider", "model"])


def test_valid_to_is_respected_on_request(spark):
    ended = list(factor("2026-01-01"))
    ended[3] = dt.date(2026, 2, 1)
    factors = spark.createDataFrame([tuple(ended)], ENV_FACTORS)
    rows = spark.createDataFrame([("anthropic", SONNET, dt.date(2026, 2, 1))], "provider string, model string, day date")
    join = lambda **o: asof.asof_join(rows, factors, ["provider", "model"], F.col("day"), **o).first()._matched
    assert join()
    assert not join(respect_valid_to=True)
    assert asof.lookup_environmental_factors(factors, "anthropic", SONNET, "2026-02-01").count() == 0


def test_aggregate_equals_a_fold_over_rows(spark):
    rng = random.Random(8)
    events = [event(f"2026-0{rng.randint(1, 6)}-{rng.randint(10, 28)}T0{rng.randint(0, 9)}:00", tuple(rng.randint(0, 10**6) for _ in range(5)), rng.choice([SONNET, "other"])) for _ in range(200)]
    got = {(r.bucket, r.model): r for r in aggregate(spark, events, VERSIONS, [grid(), grid("2026-03-15", 0.4, None, None)], granularity="month").collect()}
    expected = {}
    for e in events:
        day, model, tokens = e[1].date(), e[2], e[3:8]
        version = max((v for v in VERSIONS if v[1] == model and v[2] <= day), key=lambda v: v[2], default=None)
        energy = sum(t * w for t, w in zip(tokens, version[4:9], strict=True)) / 1e6 if version else 0.0
        co2e, water, pue = (0.30, 0.20, 1.15) if day < dt.date(2026, 3, 15) else (0.4, None, 1.0)
        sums = expected.setdefault((day.replace(day=1).isoformat(), model), [0.0, 0.0, 0.0, None])
        sums[0] += energy
        sums[1] += energy * pue
        sums[2] += energy * pue * co2e
        if water is not None:
            sums[3] = (sums[3] or 0.0) + energy * pue / 1000 * water
    assert set(got) == set(expected)
    for key, sums in expected.items():
        r = got[key]
        assert (r.energy_wh, r.facility_wh, r.co2e_g) == pytest.approx(sums[:3], abs=1e-9)
        assert r.water_l == (None if sums[3] is None else pytest.approx(sums[3], abs=1e-9))


def test_window_impact_and_flags(spark):
    by_bucket = aggregate(spark, [event("2026-04-20T01:00"), event("2026-05-20T01:00")], [factor("2026-01-01")], [grid()])
    r = impact.window_impact(by_bucket).first()
    assert (r.energy_wh, r.events_count, r.indirect_water_l, r.model_uncertainty_pct) == (pytest.approx(1.4), 2, None, 35)
    assert impact.environment_ready("production", False)
    assert not impact.environment_ready("needs_review", False)
    nothing = list(factor("2026-01-01"))
    nothing[4:9] = [None] * 5
    assert impact.all_null_factor_rows(spark.createDataFrame([tuple(nothing), VERSIONS[0]], ENV_FACTORS)).first()[0] == 1
