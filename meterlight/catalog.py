"""The registered queries of the usage-analytics library, each with its SQL oracle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_io, catalog_tables
from .functions import buckets, maths, text
from .operators import asof, billing, chart, cost, impact, usage
from .plans import daily_report
from .schemas import TOKEN_COLUMNS
from .sources import adapter, session_logs
from .sources.adapter import Tables
from .sources.store import Store
from .streaming import ingest

START, END = "2024-01-01", "2024-01-31"
LEDGER_START, LEDGER_END = "1995-01-01", "1995-12-31"
REGION, PUE, WUE = "us-east-1", 1.15, 0.15
PROJECTS = ["/proj/1", "/proj/3", "/proj/5"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

TOKENS = ", ".join(TOKEN_COLUMNS)
TOTAL = " + ".join(TOKEN_COLUMNS)
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKEN_COLUMNS)
CTES = f"""
WITH usage_events AS ({adapter.EVENTS_SQL}), sources AS ({adapter.SOURCES_SQL}), pricing AS ({adapter.PRICING_SQL}),
factors AS ({adapter.FACTORS_SQL}), grids AS ({adapter.GRIDS_SQL}),
charges_raw AS ({adapter.CHARGES_SQL}), subscriptions AS ({adapter.SUBSCRIPTIONS_SQL}),
charges AS (
  SELECT *, CASE WHEN amount_usd < 0 THEN 'refund'
    WHEN lower(description) LIKE '%refund%' OR lower(description) LIKE '%credit memo%' OR lower(description) LIKE '%chargeback%' THEN 'refund'
    WHEN lower(description) LIKE '%overage%' OR lower(description) LIKE '%usage%' OR lower(description) LIKE '%metered%' THEN 'overage'
    WHEN lower(description) LIKE '%subscription%' OR lower(description) LIKE '%monthly%' OR lower(description) LIKE '%pro plan%' THEN 'subscription'
    WHEN lower(description) LIKE '%setup%' OR lower(description) LIKE '%one-time%' THEN 'one_time' ELSE 'unknown' END AS category
  FROM charges_raw
),
u AS (
  SELECT e.*, s.provider FROM usage_events e JOIN sources s ON e.source = s.kind
  WHERE CAST(occurred_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
),
ef AS (SELECT *, lead(valid_from) OVER (PARTITION BY provider, model ORDER BY valid_from) AS nx FROM factors),
gf AS (SELECT *, lead(valid_from) OVER (ORDER BY valid_from) AS nx FROM grids WHERE region = '{REGION}'),
"""


def _bucket(granularity: str, column: str = "occurred_at") -> str:
    return f"strftime(date_trunc('{granularity}', {column}), '%Y-%m-%d')"


def _impact(granularity: str, pue: float | None, wue: float | None) -> str:
    """CTE ``impact``: the bucketed impact, with unrounded figures."""
    energy = " + ".join(f"{c} * coalesce({w}, 0e0)" for c, w in zip(TOKEN_COLUMNS, impact.WH_COLUMNS, strict=True))
    water = "water_l_per_kwh" if wue is None else f"coalesce(water_l_per_kwh, {wue}e0)"
    band = lambda c: f"CAST(round(sqrt(pow(max(coalesce(uncertainty_range_pct, 0)), 2) + pow(max(coalesce({c}, 0)), 2))) AS INT)"
    return f"""
rows_ AS (
  SELECT u.*, ef.model IS NULL AS no_factor, ef.uncertainty_range_pct, gf.pue, gf.water_l_per_kwh, gf.co2e_kg_per_kwh, gf.indirect_water_l_per_kwh,
         gf.co2e_uncertainty_range_pct AS gc, gf.water_uncertainty_range_pct AS gw, gf.indirect_water_uncertainty_range_pct AS gi,
         ({energy}) / 1e6 AS energy_wh
  FROM u
  LEFT JOIN ef ON ef.provider = u.provider AND ef.model = u.model AND ef.valid_from <= CAST(occurred_at AS DATE) AND (ef.nx IS NULL OR CAST(occurred_at AS DATE) < ef.nx)
  LEFT JOIN gf ON gf.valid_from <= CAST(occurred_at AS DATE) AND (gf.nx IS NULL OR CAST(occurred_at AS DATE) < gf.nx)
),
facility AS (SELECT *, energy_wh * coalesce(pue, {1.0 if pue is None else pue}e0) AS facility_wh FROM rows_),
impact AS (
  SELECT {_bucket(granularity)} AS bucket, provider, model, {SUMS},
    sum(energy_wh) AS energy_wh, sum(facility_wh) AS facility_wh, sum(facility_wh * co2e_kg_per_kwh) AS co2e_g,
    sum(facility_wh / 1000 * {water}) AS water_l, sum(facility_wh / 1000 * indirect_water_l_per_kwh) AS indirect_water_l,
    CAST(coalesce(max(uncertainty_range_pct), 0) AS INT) AS model_uncertainty_pct,
    {band("gc")} AS co2e_uncertainty_pct, {band("gw")} AS water_uncertainty_pct, {band("gi")} AS indirect_water_uncertainty_pct,
    count(*) FILTER (WHERE no_factor) AS events_missing_env_factor,
    count(*) FILTER (WHERE pue IS NULL) AS events_using_fallback_pue,
    count(*) FILTER (WHERE water_l_per_kwh IS NULL) AS events_using_fallback_wue,
    count(*) AS events_count
  FROM facility GROUP BY 1, 2, 3
)
"""


FIGURES = ("energy_wh", "facility_wh", "co2e_g", "water_l", "indirect_water_l")
BANDS = "model_uncertainty_pct, co2e_uncertainty_pct, water_uncertainty_pct, indirect_water_uncertainty_pct"
COUNTS = "events_missing_env_factor, events_using_fallback_pue, events_using_fallback_wue, events_count"
#: Decimals of impact figures. Energy lies on a grid of 1e-7, with PUE on one of 1e-9, and is compared there: rounded more
#: coarsely, sums that differ in their last bit would round apart at exact halves. The other figures' grids are too fine for that,
#: and so is that of a whole window's facility energy.
DIGITS = {"energy_wh": 7, "facility_wh": 9, "co2e_g": 4, "water_l": 4, "indirect_water_l": 4}
WINDOW_DIGITS = DIGITS | {"facility_wh": 4}
ROUNDED = ", ".join(f"round({c}, {d}) AS {c}" for c, d in DIGITS.items())


def _cells(granularity: str) -> str:
    """CTEs ``cells`` (token sums per bucket and model) and ``billable``."""
    mult = {
        "input_tokens": "CASE WHEN p.model IS NOT NULL THEN 1e0 END", "output_tokens": "output_usd_per_mtok / input_usd_per_mtok", "cache_read_tokens": "cache_read_usd_per_mtok / input_usd_per_mtok",
        "cache_write_5m_tokens": "cache_write_5m_multiplier", "cache_write_1h_tokens": "cache_write_1h_multiplier",
    }
    columns = ", ".join(f"CAST(trunc(greatest({c}, 0) * ({m})) AS BIGINT) AS billable_{c}" for c, m in mult.items())
    weighted = " + ".join(f"{c} * ({m})" for c, m in mult.items())
    return f"""
cells AS (SELECT {_bucket(granularity)} AS bucket, provider, model, {SUMS} FROM u GROUP BY 1, 2, 3),
billable AS (
  SELECT c.*, p.input_usd_per_mtok, p.model IS NOT NULL AS priced, {columns}, {weighted} AS weighted_total
  FROM cells c LEFT JOIN pricing p ON p.provider = c.provider AND p.model = c.model
)
"""


BILLABLE_TOTAL = " + ".join(cost.BILLABLE_COLUMNS)
CELL_COST = " + ".join(f"{c} * input_usd_per_mtok / 1e6" for c in cost.BILLABLE_COLUMNS)


def _register(name: str, sql: str | None = None):
    def add(function):
        _QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _figures(df: DataFrame, digits: dict[str, int] = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _cell_frame(t: Tables, granularity: str) -> DataFrame:
    rows = usage.usage(t.events, t.sources, START, END)
    label = buckets.bucket_label(F.col("occurred_at"), granularity).alias("bucket")
    return rows.groupBy(label, "provider", "model").agg(*[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLUMNS])


def _breakdown(t: Tables, granularity: str = "week") -> DataFrame:
    return cost.billable_breakdown(_cell_frame(t, granularity), t.pricing)


def _impact_frame(t: Tables, granularity: str, pue: float | None = PUE, wue: float | None = WUE) -> DataFrame:
    return impact.aggregate_impact_by_bucket(t.events, t.sources, t.factors, t.grids, START, END, granularity=granularity, region=REGION, fallback_pue=pue, fallback_wue=wue)


# Usage


@_register("daily_usage", f"{CTES} x AS (SELECT 1) SELECT {_bucket('day')} AS date, model, CAST(sum({TOTAL}) AS BIGINT) AS total_tokens FROM u GROUP BY 1, 2")
def _(t):
    return usage.daily_usage(t.events, t.sources, START, END)


for _granularity in buckets.GRANULARITIES:

    @_register(f"usage_breakdown_{_granularity}", f"{CTES} x AS (SELECT 1) SELECT {_bucket(_granularity)} AS bucket, model, {SUMS} FROM u GROUP BY 1, 2")
    def _(t, granularity=_granularity):
        return usage.daily_usage_breakdown(t.events, t.sources, START, END, granularity=granularity)


@_register(
    "usage_breakdown_projects",
    f"{CTES} x AS (SELECT 1) SELECT {_bucket('week')} AS bucket, model, {SUMS} FROM u WHERE provider = 'anthropic' AND project_id IN {tuple(PROJECTS)} GROUP BY 1, 2",
)
def _(t):
    return usage.daily_usage_breakdown(t.events, t.sources, START, END, "anthropic", usage.parse_projects(",".join(PROJECTS)), "week")


@_register("usage_no_project", f"{CTES} x AS (SELECT 1) SELECT {_bucket('day')} AS bucket, model, {SUMS} FROM u WHERE 1 = 0 GROUP BY 1, 2")
def _(t):
    return usage.daily_usage_breakdown(t.events, t.sources, START, END, projects=usage.parse_projects(usage.NO_PROJECT))


@_register("models_in_window", f"{CTES} x AS (SELECT 1) SELECT model, CAST(sum({TOTAL}) AS BIGINT) AS total_tokens FROM u GROUP BY 1 HAVING sum({TOTAL}) > 0")
def _(t):
    return usage.list_models_in_window(t.events, t.sources, START, END)


@_register(
    "projects_with_totals",
    f"{CTES} x AS (SELECT 1) SELECT project_id, count(*) AS events_count, CAST(sum({TOTAL}) AS BIGINT) AS total_tokens FROM u WHERE project_id IS NOT NULL GROUP BY 1",
)
def _(t):
    return usage.list_projects_with_totals(t.events, t.sources, START, END)


@_register("usage_by_model", f"{CTES} x AS (SELECT 1) SELECT model, count(*) AS events_count, {SUMS} FROM u GROUP BY 1")
def _(t):
    return usage.usage_by_model(t.events, t.sources, START, END)


@_register("recent_sessions", f"""{CTES} x AS (SELECT 1)
SELECT session_id, project_id, min(occurred_at) AS started_at, max(occurred_at) AS ended_at, count(*) AS events_count, CAST(sum({TOTAL}) AS BIGINT) AS total_tokens
FROM usage_events WHERE session_id IS NOT NULL GROUP BY 1, 2 ORDER BY ended_at DESC, session_id, project_id NULLS FIRST LIMIT 25""")
def _(t):
    return usage.recent_sessions(t.events)


@_register("count_events", "SELECT count(*) AS events_count FROM events")
def _(t):
    return usage.count_events(t.events)


@_register("health_summary", "SELECT count(*) AS events_count, 'anthropic' AS providers FROM events")
def _(t):
    return usage.health_summary(t.events, t.sources).withColumn("providers", F.array_join("providers", ","))


@_register("source_kinds", f"{CTES} x AS (SELECT 1) SELECT kind, (SELECT count(*) FROM usage_events WHERE source = kind) AS events_count FROM sources")
def _(t):
    """The kinds with their events, those without events too."""
    found = t.events.groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return usage.source_kinds(t.sources).join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("events_count"))


# Impact


@_register("impact_weekly", f"{CTES} {_impact('week', PUE, WUE)} SELECT bucket, provider, model, {TOKENS}, {ROUNDED}, {BANDS}, {COUNTS} FROM impact")
def _impact_weekly(t):
    return _figures(_impact_frame(t, "week"))


@_register("impact_daily_no_fallback", f"{CTES} {_impact('day', None, None)} SELECT bucket, provider, model, {TOKENS}, {ROUNDED}, {BANDS}, {COUNTS} FROM impact")
def _(t):
    return _figures(_impact_frame(t, "day", None, None))


@_register("window_impact", f"""{CTES} {_impact('month', PUE, WUE)}
SELECT {", ".join(f"round(sum({c}), {d}) AS {c}" for c, d in WINDOW_DIGITS.items())}, {", ".join(f"max({c}) AS {c}" for c in BANDS.split(", "))},
{", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS.split(", "))} FROM impact""")
def _(t):
    return _figures(impact.window_impact(_impact_frame(t, "month")), WINDOW_DIGITS)


@_register("asof_model_factors", f"""{CTES} x AS (SELECT 1)
SELECT event_id, ef.wh_per_mtok_input AS ef_wh_per_mtok_input, ef.model IS NOT NULL AS ef__matched FROM u
LEFT JOIN ef ON ef.provider = u.provider AND ef.model = u.model AND ef.valid_from <= CAST(occurred_at AS DATE) AND (ef.nx IS NULL OR CAST(occurred_at AS DATE) < ef.nx)""")
def _(t):
    rows = usage.usage(t.events, t.sources, START, END)
    return asof.asof_join(rows, t.factors, ["provider", "model"], F.to_date("occurred_at"), prefix="ef_").select("event_id", "ef_wh_per_mtok_input", "ef__matched")


@_register("asof_customers", """
WITH v AS (SELECT c_custkey AS user_id, CAST(DATE '2024-01-01' + CAST((c_custkey * 7 + k * 11) % 40 AS INT) AS DATE) AS valid_from, c_acctbal + k AS balance FROM customer, (VALUES (0), (1), (2)) AS t(k))
SELECT event_id, balance, valid_from, v.user_id IS NOT NULL AS _matched FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.day >= v.valid_from""")
def _(t):
    """A dimension of any size: three versions of every customer."""
    first = F.lit("2024-01-01").cast("date")
    versions = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    versions = versions.select(F.col("c_custkey").alias("user_id"), F.date_add(first, ((F.col("c_custkey") * 7 + F.col("k") * 11) % 40).cast("int")).alias("valid_from"), (F.col("c_acctbal") + F.col("k")).alias("balance"))
    rows = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return asof.asof_join_by_days(rows, versions, ["user_id"], F.to_date("ts")).select("event_id", "balance", "valid_from", "_matched")


@_register("asof_part_prices", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice, l_returnflag FROM lineitem),
v AS (SELECT l_partkey, day AS valid_from, max(l_extendedprice) AS price FROM l WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, price FROM l ASOF LEFT JOIN v ON l.l_partkey = v.l_partkey AND l.day >= v.valid_from""")
def _(t):
    """Each line with the highest price at which its part last came back until that day."""
    lines = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").withColumn("day", F.to_date("l_shipdate")).select("l_orderkey", "l_linenumber", "l_partkey", "day", "l_extendedprice", "l_returnflag")
    versions = lines.where("l_returnflag = 'R'").groupBy("l_partkey", F.col("day").alias("valid_from")).agg(F.max("l_extendedprice").alias("price"))
    return asof.asof_join_by_days(lines, versions, ["l_partkey"], F.col("day")).select("l_orderkey", "l_linenumber", "price")


VALID = "{v}.valid_from <= a.day AND ({v}.nx IS NULL OR a.day < {v}.nx) AND ({v}.valid_to IS NULL OR a.day < {v}.valid_to)"


@_register("lookup_model_factors", f"""{CTES} a AS (SELECT DISTINCT provider, model, CAST(occurred_at AS DATE) AS day FROM u)
SELECT a.model, a.day, ef.wh_per_mtok_input, ef.valid_from FROM a LEFT JOIN ef ON ef.provider = a.provider AND ef.model = a.model AND {VALID.format(v='ef')}""")
def _(t):
    """The factors of every model on every day on which it was used."""
    asked = usage.usage(t.events, t.sources, START, END).select("provider", "model", F.to_date("occurred_at").alias("day")).distinct()
    return asof.lookup_all(asked, t.factors, ["provider", "model"], "day").select("model", "day", "wh_per_mtok_input", "valid_from")


@_register("lookup_grid_factors", f"""{CTES} a AS (SELECT DISTINCT CAST(occurred_at AS DATE) AS day FROM u)
SELECT a.day, gf.region, gf.co2e_kg_per_kwh, gf.pue FROM a LEFT JOIN gf ON {VALID.format(v='gf')}""")
def _(t):
    asked = usage.usage(t.events, t.sources, START, END).select(F.lit(REGION).alias("region"), F.to_date("occurred_at").alias("day")).distinct()
    found = asof.lookup_all(asked, t.grids, ["region"], "day")
    return found.select("day", F.when(F.col("_matched"), F.col("region")).alias("region"), "co2e_kg_per_kwh", "pue")


@_register("all_null_factor_rows", f"""{CTES} f AS (SELECT model, day(occurred_at) AS d, max(CASE WHEN event_id % 8 = 0 THEN input_tokens END) AS a, max(CASE WHEN event_id % 16 = 1 THEN output_tokens END) AS b FROM u GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS all_null_rows FROM f""")
def _(t):
    """Factors per model and day, some of them without any figure, made from the events."""
    rows = usage.usage(t.events, t.sources, START, END).groupBy("model", F.dayofmonth("occurred_at").alias("d"))
    made = rows.agg(F.max(F.when(F.col("event_id") % 8 == 0, F.col("input_tokens"))).alias("a"), F.max(F.when(F.col("event_id") % 16 == 1, F.col("output_tokens"))).alias("b"))
    none = F.lit(None).cast("double")
    return impact.all_null_factor_rows(made.select("model", *[c.alias(n) for c, n in zip((F.col("a"), F.col("b"), none, none, none), impact.WH_COLUMNS, strict=True)]))


@_register("grid_sentinels", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS co2e_kg_per_kwh, CASE WHEN s_suppkey % 3 <> 0 THEN 1.5e0 END AS pue FROM supplier""")
def _(t):
    """A grid row for every supplier, with sentinels (0, and a PUE of 1) for what is not known."""
    from .sources.dims import sentinels_to_null

    rows = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet")
    key, none = F.col("s_suppkey"), F.lit(None).cast("double")
    made = rows.select("s_suppkey", F.when(key % 5 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("co2e_kg_per_kwh"), F.when(key % 3 == 0, 1.0).otherwise(1.5).alias("pue"), none.alias("water_l_per_kwh"), none.alias("indirect_water_l_per_kwh"))
    return sentinels_to_null(made).select("s_suppkey", "co2e_kg_per_kwh", "pue")


# Cost


@_register("usage_daily_report", f"""{CTES} {_impact('day', PUE, WUE)}, {_cells('day')}
SELECT i.bucket, i.provider, i.model, {", ".join("i." + c for c in TOKEN_COLUMNS)}, {", ".join(f"round(i.{c}, {d}) AS {c}" for c, d in DIGITS.items())}, events_count,
  priced, {", ".join(cost.BILLABLE_COLUMNS)}, {BILLABLE_TOTAL} AS billable_total
FROM impact i JOIN billable b ON b.bucket = i.bucket AND b.provider = i.provider AND b.model = i.model
WHERE i.model IN (SELECT model FROM u GROUP BY 1 HAVING sum({TOTAL}) > 0)""")
def _(t):
    found = daily_report.usage_daily(t.events, t.sources, t.pricing, t.factors, t.grids, START, END, region=REGION, fallback_pue=PUE, fallback_wue=WUE)
    return _figures(found).select("bucket", "provider", "model", *TOKEN_COLUMNS, *FIGURES, "events_count", "priced", *cost.BILLABLE_COLUMNS, "billable_total")


@_register("billable_breakdown", f"{CTES} {_cells('week')} SELECT bucket, provider, model, priced, {', '.join(cost.BILLABLE_COLUMNS)}, {BILLABLE_TOTAL} AS billable_total FROM billable")
def _(t):
    return _breakdown(t).select("bucket", "provider", "model", "priced", *cost.BILLABLE_COLUMNS, "billable_total")


@_register("weighted_tokens", f"{CTES} {_cells('month')} SELECT bucket, model, round(weighted_total, 2) AS weighted_total FROM billable")
def _(t):
    return _rounded(cost.weighted_tokens(_cell_frame(t, "month"), t.pricing).select("bucket", "model", "weighted_total"), "weighted_total", digits=2)


@_register("counterfactual_cost", f"{CTES} {_cells('week')} SELECT round(sum({CELL_COST}), 4) AS cost_usd FROM billable")
def _(t):
    return _rounded(cost.counterfactual_cost(_breakdown(t)), "cost_usd")


@_register("counterfactual_cost_selected", f"""{CTES} {_cells('week')}
SELECT round(sum((billable_input_tokens * input_usd_per_mtok / 1e6) + (billable_output_tokens * input_usd_per_mtok / 1e6)), 4) AS cost_usd
FROM billable WHERE model IN ('model-large', 'model-unpriced')""")
def _(t):
    return _rounded(cost.counterfactual_cost(_breakdown(t), ["model-large", "model-unpriced"], ["input_tokens", "output_tokens"]), "cost_usd")


@_register("cost_by_model", f"""{CTES} {_cells('week')}, c AS (SELECT model, sum({CELL_COST}) AS cost_usd FROM billable WHERE priced GROUP BY 1)
SELECT model, round(cost_usd, 4) AS cost_usd, round(cost_usd / sum(cost_usd) OVER (), 6) AS cost_share FROM c""")
def _(t):
    return _rounded(_rounded(cost.cost_by_model(_breakdown(t)), "cost_usd"), "cost_share", digits=6)


@_register("cache_stats", f"""{CTES} {_cells('week')}
SELECT round(sum(cache_read_tokens) / sum(input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens), 6) AS cached_fraction,
       round(sum(cache_read_tokens * 0.9e0 * input_usd_per_mtok / 1e6), 4) AS saved_usd FROM billable""")
def _(t):
    return _rounded(_rounded(cost.cache_stats(_breakdown(t)), "cached_fraction", digits=6), "saved_usd")


@_register("models_without_pricing", f"{CTES} {_cells('month')} SELECT DISTINCT model FROM billable WHERE NOT priced")
def _(t):
    return cost.models_without_pricing(_cell_frame(t, "month"), t.pricing)


@_register("models_without_factors", f"{CTES} x AS (SELECT 1) SELECT DISTINCT model FROM u WHERE model NOT IN (SELECT model FROM factors)")
def _(t):
    return cost.models_without_factors(_cell_frame(t, "month"), t.factors)


@_register("pricing_by_model", f"{CTES} x AS (SELECT 1) SELECT DISTINCT u.model, input_usd_per_mtok FROM u JOIN pricing p ON p.model = u.model")
def _(t):
    return cost.pricing_by_model(_cell_frame(t, "month"), t.pricing)


@_register("priced_rows", f"{CTES} {_cells('month')} SELECT bucket, model, {TOKENS} FROM billable WHERE priced")
def _(t):
    return cost.priced_only(_cell_frame(t, "month"), t.pricing)[0].select("bucket", "model", *TOKEN_COLUMNS)


# Billing

LEDGER = f"occurred_at BETWEEN DATE '{LEDGER_START}' AND DATE '{LEDGER_END}'"


@_register("charges_in_window", f"{CTES} x AS (SELECT 1) SELECT id, occurred_at, amount_usd, description, category FROM charges WHERE {LEDGER}")
def _(t):
    return billing.charges_in_window(t.charges, LEDGER_START, LEDGER_END).select("id", "occurred_at", "amount_usd", "description", "category")


@_register("sum_charges", f"{CTES} x AS (SELECT 1) SELECT round(coalesce(sum(amount_usd), 0e0), 4) AS total_usd FROM charges WHERE {LEDGER} AND source = 'orders'")
def _(t):
    return _rounded(billing.sum_charges_in_window(t.charges, LEDGER_START, LEDGER_END, "orders"), "total_usd")


BY_KIND = f"""kinds AS (
  SELECT coalesce(sum(amount_usd) FILTER (WHERE category = 'subscription'), 0e0) AS subscription_usd,
         coalesce(sum(amount_usd) FILTER (WHERE category <> 'subscription'), 0e0) AS other_usd FROM charges WHERE {LEDGER})"""


@_register("charges_by_kind", f"{CTES} {BY_KIND} SELECT round(subscription_usd, 4) AS subscription_usd, round(other_usd, 4) AS other_usd FROM kinds")
def _(t):
    return _rounded(billing.charges_by_kind(t.charges, LEDGER_START, LEDGER_END), "subscription_usd", "other_usd")


@_register("charges_by_category", f"{CTES} x AS (SELECT 1) SELECT category, count(*) AS n FROM charges GROUP BY 1")
def _(t):
    return t.charges.groupBy(text.decode_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@_register("imported_subscriptions", f"""{CTES} x AS (SELECT 1)
SELECT round(amount_usd, 2) AS amount_usd, coalesce(description, '') AS description, count(*) AS n_charges, min(occurred_at) AS first_at, max(occurred_at) AS last_at,
       round(sum(amount_usd), 4) AS total_usd FROM charges WHERE category = 'subscription' GROUP BY 1, 2""")
def _(t):
    return _rounded(billing.imported_subscriptions(t.charges), "total_usd")


@_register("subscription_conflicts", f"""{CTES} x AS (SELECT 1)
SELECT s.id, plan_name, count(*) AS n_charges, md5(string_agg(external_id, ',' ORDER BY c.occurred_at, external_id)) AS external_ids
FROM subscriptions s JOIN charges c ON category = 'subscription' AND external_id IS NOT NULL AND started_at <= c.occurred_at AND (ended_at IS NULL OR c.occurred_at <= ended_at)
GROUP BY 1, 2""")
def _(t):
    found = billing.subscription_conflicts(t.charges, t.subscriptions)
    return found.select("id", "plan_name", F.size("external_ids").cast("bigint").alias("n_charges"), F.md5(F.array_join("external_ids", ",")).alias("external_ids"))


@_register("conflict_charges", f"""{CTES} x AS (SELECT 1)
SELECT s.id, plan_name, external_id FROM subscriptions s
JOIN charges c ON category = 'subscription' AND external_id IS NOT NULL AND started_at <= c.occurred_at AND (ended_at IS NULL OR c.occurred_at <= ended_at)""")
def _(t):
    return billing.conflict_charges(t.charges, t.subscriptions).select("id", "plan_name", "external_id")


OVERLAP = f"""spans AS (
  SELECT *, (least(coalesce(epoch_ms(CAST(ended_at AS TIMESTAMP)) + 86399999, epoch_ms(TIMESTAMP '{LEDGER_END}') + 86399999), epoch_ms(TIMESTAMP '{LEDGER_END}') + 86399999)
     - greatest(epoch_ms(CAST(started_at AS TIMESTAMP)), epoch_ms(TIMESTAMP '{LEDGER_START}'))) / 86400000e0 AS days FROM subscriptions)"""


@_register("prorated_subscriptions", f"{CTES} {OVERLAP} SELECT id, round(days, 6) AS overlap_days, round(monthly_usd * days / 30.4375e0, 4) AS prorated_usd FROM spans WHERE days > 0")
def _(t):
    found = billing.prorated_subscriptions(t.subscriptions, LEDGER_START, LEDGER_END).select("id", "overlap_days", "prorated_usd")
    return _rounded(_rounded(found, "overlap_days", digits=6), "prorated_usd")


@_register("net_value", f"""{CTES} {_cells('week')}, {BY_KIND}, {OVERLAP},
parts AS (SELECT (SELECT sum({CELL_COST}) FROM billable) AS cost_usd, (SELECT sum(monthly_usd * days / 30.4375e0) FROM spans WHERE days > 0) AS subscriptions_usd,
          (SELECT subscription_usd + other_usd FROM kinds) AS imported_usd)
SELECT round(cost_usd, 4) AS cost_usd, round(subscriptions_usd, 4) AS subscriptions_usd, round(imported_usd, 4) AS imported_usd,
  round(subscriptions_usd + imported_usd, 4) AS billed_usd, round(cost_usd - (subscriptions_usd + imported_usd), 4) AS net_usd FROM parts""")
def _(t):
    prorated = billing.prorated_subscriptions(t.subscriptions, LEDGER_START, LEDGER_END)
    found = daily_report.net_value_report(_breakdown(t), prorated, billing.charges_by_kind(t.charges, LEDGER_START, LEDGER_END))
    return _rounded(found, "cost_usd", "subscriptions_usd", "imported_usd", "billed_usd", "net_usd")


@_register("subscriptions", f"{CTES} x AS (SELECT 1) SELECT id, plan_name, monthly_usd, started_at, ended_at FROM subscriptions")
def _(t):
    return billing.list_subscriptions(t.subscriptions)


@_register("category_overrides", f"{CTES} x AS (SELECT 1) SELECT id, CASE WHEN external_id = 'in_1' THEN 'one_time' ELSE category END AS category FROM charges")
def _(t):
    overrides = t.spark.createDataFrame([("in_1", "one_time"), ("row:-1", "refund")], "key string, category string")
    rows = t.charges.withColumn("position", F.col("id"))
    return billing.apply_overrides(rows, overrides).select("id", "category")


# Charts

MODELS = ["model-large", "model-medium", "model-small"]
CALENDAR = f"""calendar AS (SELECT CAST(unnest(generate_series(date_trunc('week', DATE '{START}'), TIMESTAMP '{END}', INTERVAL 7 DAY)) AS DATE) AS bucket),
days AS (SELECT bucket, greatest(date_diff('day', greatest(bucket, DATE '{START}'), CAST(least(bucket + 7, DATE '{END}' + 1) AS DATE)), 1) AS active FROM calendar)"""


@_register("stack_by_model", f"""{CTES} {_cells('week')}, {CALENDAR}
SELECT d.bucket, {", ".join(f"round(coalesce(sum({TOTAL}) FILTER (WHERE model = '{m}'), 0) / max(active), 6) AS {m.replace('-', '_')}" for m in MODELS)}
FROM days d LEFT JOIN cells c ON CAST(c.bucket AS DATE) = d.bucket GROUP BY 1""")
def _(t):
    found = chart.stack_by_model(_cell_frame(t, "week"), MODELS, START, END, "week")
    return found.select("bucket", *[F.round(F.col(f"`{m}`"), 6).alias(m.replace("-", "_")) for m in MODELS])


@_register("stack_by_token_type", f"""{CTES} {_cells('week')}, {CALENDAR}
SELECT d.bucket, {", ".join(f"round(coalesce(sum({c}), 0) / max(active), 6) AS {c}" for c in TOKEN_COLUMNS)}
FROM days d LEFT JOIN cells c ON CAST(c.bucket AS DATE) = d.bucket AND model IN {tuple(MODELS)} GROUP BY 1""")
def _(t):
    found = chart.stack_by_token_type(_cell_frame(t, "week"), MODELS, START, END, "week")
    return _rounded(found, *TOKEN_COLUMNS, digits=6)


@_register("nested_by_bucket", f"{CTES} {_cells('week')} SELECT bucket, count(*) AS n_models, string_agg(provider || '/' || model, ',' ORDER BY model) AS models FROM cells GROUP BY 1")
def _(t):
    nested = chart.nest_by_bucket(_cell_frame(t, "week"), TOKEN_COLUMNS)
    return nested.select("bucket", F.size("by_model").cast("bigint").alias("n_models"), F.array_join(F.array_sort(F.map_keys("by_model")), ",").alias("models"))


# Functions


@_register("names_and_families", """
SELECT DISTINCT model, CASE WHEN model = 'claude-opus-4-7' THEN 'Claude Opus 4.7' ELSE model END AS display_name,
  CASE WHEN contains(model, 'opus') THEN 'opus' ELSE 'other' END AS family
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'claude-opus-4-7' ELSE concat('x-', event_type) END AS model FROM events)""")
def _(t):
    rows = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.when(F.col("event_type") == "purchase", "claude-opus-4-7").otherwise(F.concat(F.lit("x-"), "event_type")).alias("model")).distinct()
    return rows.select("model", text.model_display_name(F.col("model")).alias("display_name"), text.model_family(F.col("model")).alias("family"))


@_register("project_names", f"{CTES} x AS (SELECT 1) SELECT DISTINCT project_id, split_part(project_id, '/', 3) AS name FROM usage_events WHERE project_id IS NOT NULL")
def _(t):
    return t.events.where("project_id is not null").select("project_id").distinct().withColumn("name", text.project_short_name(F.col("project_id")))


@_register("uncertainty_maths", """
SELECT event_id, CAST(round(sqrt(a * a + b * b)) AS INT) AS combined, CASE WHEN b > 0 THEN round(v * (1 - b / 100e0), 6) END AS low,
  CASE WHEN b < 5 THEN 4 WHEN b < 15 THEN 3 ELSE 2 END AS digits
FROM (SELECT event_id, CAST(event_id % 40 AS INT) AS a, CAST(event_id % 60 AS INT) AS b, value AS v FROM events)""")
def _(t):
    rows = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    a, b = (F.col("event_id") % 40).cast("int"), (F.col("event_id") % 60).cast("int")
    return rows.select(
        "event_id", maths.combine_uncertainty(a, b).alias("combined"), F.round(maths.bracket(F.col("value"), b)["low"], 6).alias("low"), maths.significant_digits(b).alias("digits")
    )


@_register("content_hashes", f"""{CTES} x AS (SELECT 1)
SELECT event_id, sha256(concat_ws('|', strftime(date_trunc('millisecond', occurred_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', model, {", ".join(f"CAST({c} AS VARCHAR)" for c in TOKEN_COLUMNS)},
  coalesce(session_id, ''), coalesce(project_id, ''))) AS content_hash FROM usage_events""")
def _(t):
    return t.events.select("event_id", session_logs.content_hash().alias("content_hash"))


# Ingest: rows become session logs and are read back


def _work_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meterlight-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write_logs(t: Tables, folder: str) -> None:
    """conversations as session logs: replies are events, other turns lines of other types."""
    rows = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet")
    size = F.length(F.coalesce("text", F.lit("")))
    usage_ = F.struct(size.alias("input_tokens"), (size * 2).alias("output_tokens"), F.struct((F.col("turn") + 1).alias("ephemeral_5m_input_tokens"), F.lit(3).alias("ephemeral_1h_input_tokens")).alias("cache_creation"))
    line = F.to_json(F.struct(
        F.col("role").alias("type"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat_ws("_", F.lit("req"), "conv_id", "turn").alias("requestId"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("/p").alias("cwd"),
        F.struct(F.lit("model-large").alias("model"), usage_.alias("usage")).alias("message"),
    ))
    rows.select(line.alias("value"), F.lit("logs").alias("project")).write.partitionBy("project").option("compression", "none").text(folder)


def _log_lines(t: Tables, folder: str) -> DataFrame:
    files = t.spark.read.text(f"{folder}/project=logs/*.txt", wholetext=False).select(F.input_file_name().alias("file_path"), F.monotonically_increasing_id().alias("line_number"), F.col("value").alias("raw"))
    return session_logs.parse_lines(files)


@_register("session_log_round_trip", """
SELECT concat('req_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS request_id, CAST(conv_id AS VARCHAR) AS session_id, CAST(length(coalesce("text", '')) AS BIGINT) AS input_tokens,
  CAST(length(coalesce("text", '')) * 2 AS BIGINT) AS output_tokens, CAST(turn + 1 AS BIGINT) AS cache_write_5m_tokens, CAST(3 AS BIGINT) AS cache_write_1h_tokens
FROM conversations WHERE role = 'assistant'""")
def _(t):
    folder = _work_folder(t.spark, "logs")
    _write_logs(t, folder)
    return _log_lines(t, folder).where("kind = 'event'").select("request_id", "session_id", "input_tokens", "output_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")


@_register("ingest_twice", """
SELECT CAST(count(*) AS BIGINT) AS first_inserted, CAST(0 AS BIGINT) AS second_inserted, CAST(count(*) AS BIGINT) AS second_duplicate FROM conversations WHERE role = 'assistant'""")
def _(t):
    folder = _work_folder(t.spark, "logs")
    _write_logs(t, folder)
    store, rows = Store(t.spark, _work_folder(t.spark, "store")), _log_lines(t, folder).where("kind = 'event'")
    first, second = (store.insert_events(rows, ["file_path", "line_number"]) for _ in range(2))
    return t.spark.createDataFrame([(first["inserted"], second["inserted"], second["skipped_duplicate"])], "first_inserted bigint, second_inserted bigint, second_duplicate bigint")


@_register("insert_charges_twice", f"{CTES} x AS (SELECT 1) SELECT count(*) AS n, round(sum(amount_usd), 4) AS total_usd FROM (SELECT DISTINCT coalesce(external_id, concat(CAST(occurred_at AS VARCHAR), '|', CAST(amount_usd AS VARCHAR), '|', coalesce(description, ''))) AS k, amount_usd FROM charges)")
def _(t):
    store, rows = Store(t.spark, _work_folder(t.spark, "store")), t.charges.withColumn("raw", F.lit(None).cast("string"))
    for _ in range(2):
        store.insert_charges(rows)
    return _rounded(store.charges().agg(F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("total_usd")), "total_usd")


@_register("stream_week_totals", f"{CTES} x AS (SELECT 1) SELECT CAST(date_trunc('week', occurred_at) AS DATE) AS bucket, model, {SUMS} FROM usage_events GROUP BY 1, 2")
def _(t):
    """The events as a file stream, folded into calendar buckets by Structured Streaming."""
    folder, name = _work_folder(t.spark, "stream"), f"week_totals_{uuid.uuid4().hex}"
    t.events.write.parquet(folder)
    stream = t.spark.readStream.schema(t.events.schema).parquet(folder)
    totals = ingest.bucket_totals(stream, "week")
    query = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _work_folder(t.spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.table(name)


catalog_io.register(_register, _work_folder, CTES, SUMS)
catalog_tables.register(_register, _work_folder, CTES, SUMS, _ORACLES, (START, END), _figures)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly impact by provider and model."""
    return _impact_weekly(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
