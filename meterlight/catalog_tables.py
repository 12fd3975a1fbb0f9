"""Registered queries of ledgers in several batches, orders of results, parameters, files and names, all over the given
tables. :mod:`meterlight.catalog` imports them."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import config
from .functions import buckets, selection, text
from .operators import billing, chart, impact, usage
from .schemas import TOKEN_COLUMNS
from .sources import billing_csv, dims
from .sources.adapter import EVENTS_SQL, Tables
from .sources.store import Store
from .streaming import dedup


def with_position(ordered: DataFrame) -> DataFrame:
    """The rows of an ordered result (a report of few rows) with their place in it."""
    return ordered.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def register(_register, _work_folder, CTES: str, SUMS: str, oracles: dict[str, str], window: tuple[str, str], _figures) -> None:
    """Add the queries by ``_register``."""
    START, END = window
    TOTAL = " + ".join(TOKEN_COLUMNS)

    def ledger_rows(t: Tables) -> DataFrame:
        """The events with the columns of a ledger; those without a request id have a content hash."""
        none = F.lit(None).cast("string")
        return t.events.withColumns({"content_hash": F.when(F.col("request_id").isNull(), F.col("event_id").cast("string")), "workspace_id": none, "api_key_id": none, "raw": none})

    def filled(t: Tables) -> Store:
        """A ledger in three batches, each with days of the others; the last repeats a third of the events."""
        ledger, rows = Store(t.spark, _work_folder(t.spark, "store"), buckets=8), ledger_rows(t)
        for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 <> 1"):
            ledger.insert_events(rows.where(part), ["event_id"])
        return ledger

    # Ledgers

    @_register("ledger_in_batches", f"SELECT source, model, count(*) AS n, {SUMS} FROM ({EVENTS_SQL}) GROUP BY 1, 2")
    def _(t):
        """Overlapping batches, merged parts, and a rebuild of one source in one transaction."""
        ledger, rows = filled(t), ledger_rows(t)
        ledger.compact(fan=2)
        with ledger.transaction():
            ledger.delete_events("admin_api")
            ledger.insert_events(rows, ["event_id"])
        return ledger.events().groupBy("source", "model").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])

    @_register("totals_breakdown_month", oracles["usage_breakdown_month"])
    def _(t):
        return usage.daily_usage_breakdown(filled(t).totals(), t.sources, START, END, granularity="month")

    @_register("totals_by_project", oracles["projects_with_totals"])
    def _(t):
        return usage.list_projects_with_totals(filled(t).totals(), t.sources, START, END)

    @_register("totals_impact_weekly", oracles["impact_weekly"])
    def _(t):
        found = impact.aggregate_impact_by_bucket(filled(t).totals(), t.sources, t.factors, t.grids, START, END, granularity="week", region="us-east-1", fallback_pue=1.15, fallback_wue=0.15)
        return _figures(found)

    @_register("recent_sessions_of_ledger", oracles["recent_sessions"])
    def _(t):
        ledger = filled(t)
        return usage.recent_sessions_by_day(ledger.events(), ledger.totals())

    @_register("stream_once_by_state", oracles["stream_once_by_key"])
    def _(t):
        """Every event twice in the stream, and once more after a restart; the keys are kept as state."""
        folder, ledger = _work_folder(t.spark, "stream"), Store(t.spark, _work_folder(t.spark, "store"))
        rows = ledger_rows(t).drop("event_id")
        for _ in range(2):
            rows.write.mode("append").parquet(folder)
        for _ in range(2):
            dedup.stream_once(t.spark.readStream.schema(rows.schema).parquet(folder), ledger, f"{folder}-checkpoint").awaitTermination()
            rows.where("input_tokens % 2 = 0").write.mode("append").parquet(folder)
        return ledger.events().groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])

    # Orders of results

    def ordered(name: str, order: str, columns: str):
        sql = f"SELECT {columns}, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position FROM ({oracles[name]})"
        return _register(f"{name}_order", sql)

    @ordered("daily_usage", "date, model", "date, model")
    def _(t):
        return with_position(usage.daily_usage(t.events, t.sources, START, END)).select("date", "model", "position")

    @ordered("usage_by_model", f"{TOTAL} DESC, model", "model")
    def _(t):
        return with_position(usage.usage_by_model(t.events, t.sources, START, END)).select("model", "position")

    @ordered("projects_with_totals", "total_tokens DESC, project_id", "project_id")
    def _(t):
        return with_position(usage.list_projects_with_totals(t.events, t.sources, START, END)).select("project_id", "position")

    @ordered("recent_sessions", "ended_at DESC, session_id, project_id NULLS FIRST", "session_id, project_id")
    def _(t):
        return with_position(usage.recent_sessions(t.events)).select("session_id", "project_id", "position")

    @ordered("imported_subscriptions", "amount_usd DESC, description", "amount_usd, description")
    def _(t):
        return with_position(billing.imported_subscriptions(t.charges)).select("amount_usd", "description", "position")

    # Windows, calendars

    presets = "(VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('365d', 365), ('default', 30)) AS p(preset, days)"

    @_register("windows", f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS today FROM events),
w AS (SELECT today, preset, CAST(today - CAST(days AS INT) AS DATE) AS from_day FROM d, {presets} UNION ALL SELECT today, 'all', DATE '2022-12-01' FROM d)
SELECT today, preset, from_day, CASE WHEN today - from_day <= 120 THEN 'day' WHEN today - from_day <= 730 THEN 'week' ELSE 'month' END AS granularity FROM w""")
    def _(t):
        """The windows that end on each day with events, and the granularity that suits them."""
        today = F.col("today")
        starts = F.array(*[F.struct(F.lit(p or "default").alias("preset"), buckets.window_start(today, p).alias("from_day")) for p in (*buckets.RANGE_DAYS, "all", None)])
        found = t.events.select(F.to_date("occurred_at").alias("today")).distinct().select("today", F.inline(starts))
        return found.withColumn("granularity", buckets.granularity_for(F.datediff("today", "from_day")))

    @_register("calendar_weeks", """WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
w AS (SELECT CAST(unnest(generate_series(date_trunc('week', a), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS bucket, a, b FROM r)
SELECT bucket, CAST(date_diff('day', greatest(bucket, a), CAST(least(bucket + 7, b + 1) AS DATE)) AS INT) AS active_days FROM w""")
    def _(t):
        """The weeks from the first order to the last."""
        days = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate")))
        first, last = days.first()
        found = buckets.enumerate_buckets(t.spark, first, last, "week")
        return found.withColumn("active_days", buckets.active_days(F.col("bucket"), "week", first, last))

    # Cells of billing files, names, units

    @_register("csv_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
    def _(t):
        rows = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
        cell = F
        for k, form in enumerate(("yyyy-MM-dd", "yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "MMMM d yyyy", "yyyy-MM-dd 'T'")):
            cell = cell.when(F.col("o_orderkey") % 7 == k, F.replace(F.date_format("d", form), F.lit(" T"), F.lit(" 10:00")))
        return rows.select("o_orderkey", billing_csv.parse_date(cell.otherwise("soon")).alias("day"))

    @_register("csv_amounts", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 1 THEN -a WHEN 3 THEN -a ELSE a END AS amount
FROM (SELECT o_orderkey, round(o_totalprice, 2) AS a FROM orders)""")
    def _(t):
        shown, k = F.format_number("o_totalprice", 2), F.col("o_orderkey") % 5
        plain = F.replace(shown, F.lit(","), F.lit(""))
        cell = F.when(k == 0, F.concat(F.lit("$"), shown)).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, plain).when(k == 3, F.concat(F.lit("-"), plain)).otherwise(F.concat(plain, F.lit("d")))
        return t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select("o_orderkey", billing_csv.parse_amount(cell).alias("amount"))

    named = {"input_tokens": "Input", "output_tokens": "Output", "cache_read_tokens": "Cache read", "cache_write_5m_tokens": "Cache write 5m", "cache_write_1h_tokens": "Cache write 1h"}

    @_register("token_names", " UNION ALL ".join(f"SELECT '{c}' AS token_type, '{n}' AS name, CAST(sum({c}) AS BIGINT) AS tokens FROM ({EVENTS_SQL})" for c, n in named.items()))
    def _(t):
        rows = t.events.unpivot([], TOKEN_COLUMNS, "token_type", "tokens").groupBy("token_type").agg(F.sum("tokens").alias("tokens"))
        return rows.withColumn("name", text.token_type_name(F.col("token_type")))

    quarter = "(l_quantity * 0.25e0 * pow(1000, l_linenumber % 3))"

    @_register("unit_texts", f"""SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1e6 THEN format('{{:.2f}} MWh', v / 1e6) WHEN v >= 1e3 THEN format('{{:.2f}} kWh', v / 1e3) WHEN v >= 1 THEN format('{{:.2f}} Wh', v) ELSE format('{{:.2f}} mWh', v * 1e3) END AS energy,
  CASE WHEN v >= 1e3 THEN format('{{:.2f}} kL', v / 1e3) WHEN v >= 1 THEN format('{{:.2f}} L', v) ELSE format('{{:.2f}} mL', v * 1e3) END AS water FROM (SELECT l_orderkey, l_linenumber, {quarter} AS v FROM lineitem)""")
    def _(t):
        rows = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
        v = F.col("l_quantity") * 0.25 * F.pow(F.lit(1000.0), F.col("l_linenumber") % 3)
        return rows.select("l_orderkey", "l_linenumber", text.scaled(v, text.ENERGY_UNITS).alias("energy"), text.scaled(v, text.WATER_UNITS).alias("water"))

    RANKED = """SELECT model, CAST(row_number() OVER (ORDER BY count(*) DESC, model) - 1 AS INT) AS position
FROM (SELECT concat(CASE WHEN user_id % 3 = 0 THEN 'opus-' WHEN user_id % 3 = 1 THEN 'haiku-' ELSE 'x-' END, event_type) AS model FROM events) GROUP BY 1"""

    @_register("palette", f"""SELECT model, position, family, CAST(row_number() OVER (PARTITION BY family ORDER BY position) - 1 AS INT) AS "index"
FROM (SELECT *, CASE WHEN contains(model, 'opus') THEN 'opus' WHEN contains(model, 'haiku') THEN 'haiku' ELSE 'other' END AS family FROM ({RANKED}))""")
    def _(t):
        kind = F.when(F.col("user_id") % 3 == 0, "opus-").when(F.col("user_id") % 3 == 1, "haiku-").otherwise("x-")
        counts = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").groupBy(F.concat(kind, "event_type").alias("model")).count()
        ranked = counts.select("model", (F.row_number().over(Window.orderBy(F.desc("count"), "model")) - 1).alias("position"))  # a row per model
        return chart.palette_index(ranked).select("model", "position", "family", "index")

    chosen = " UNION ALL ".join(f"""SELECT '{many}' AS kind, CAST(k AS VARCHAR) AS given, CASE WHEN n = 0 THEN 'no {many}' WHEN k IS NULL THEN 'all ' || n || ' {many}' ELSE k || ' of ' || n || ' {many}' END AS said
FROM (SELECT n, unnest(list_append(generate_series(0, n), NULL)) AS k FROM (SELECT count(DISTINCT {one}) AS n FROM ({EVENTS_SQL})))""" for many, one in (("models", "model"), ("projects", "project_id")))
    status = "CASE n_nationkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'placeholder' ELSE 'draft' END"

    @_register("selection_texts", f"""{chosen} UNION ALL SELECT DISTINCT 'parameter', project_id, project_id FROM ({EVENTS_SQL}) UNION ALL
SELECT 'parameter', string_agg(project_id, ',' ORDER BY project_id) AS p, p FROM (SELECT DISTINCT model, project_id FROM ({EVENTS_SQL})) GROUP BY model UNION ALL
SELECT 'parameter', CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'all' WHEN 2 THEN '__none__' WHEN 3 THEN ',' ELSE n_name || ',,' || n_name || '/b,' END,
  CASE n_nationkey % 5 WHEN 2 THEN '__none__' WHEN 4 THEN n_name || ',' || n_name || '/b' END FROM nation UNION ALL
SELECT 'limit', CASE WHEN n_nationkey % 6 < 5 THEN CAST(n_nationkey * 25 AS VARCHAR) END, CASE WHEN n_nationkey % 6 = 5 THEN '25' WHEN n_nationkey = 0 THEN 'error' ELSE CAST(least(n_nationkey * 25, 500) AS VARCHAR) END FROM nation UNION ALL
SELECT 'ready', {status} || ' ' || n_nationkey % 2, CASE WHEN n_nationkey % 6 = 0 THEN 'true' ELSE 'false' END FROM nation""")
    def _(t):
        """What a chart says of each number of chosen models and projects, project parameters read and written again (of each project, the
        projects of each model, and what stands for all and for none), limits of sessions, and whether figures may be shown."""
        pairs = t.events.select("model", "project_id").distinct().collect()  # those of a chart
        found, by_model = [], {}
        for many, names in (("models", {r.model for r in pairs}), ("projects", {r.project_id for r in pairs})):
            known = sorted(names - {None})
            for k in (*range(len(known) + 1), None):
                found.append((many, None if k is None else str(k), selection.selection_summary(many, None if k is None else set(known[:k]), len(known))))
        for r in pairs:
            by_model.setdefault(r.model, set()).add(r.project_id)
        parameters = [*{r.project_id for r in pairs}, *(",".join(sorted(names - {None})) or None for names in by_model.values())]
        for r in t.spark.read.parquet(f"{t.sf_dir}/nation.parquet").collect():
            k, name = r.n_nationkey, r.n_name
            parameters.append(("", usage.ALL, usage.NO_PROJECT, ",", f"{name},,{name}/b,")[k % 5])
            limit = None if k % 6 == 5 else k * 25
            try:
                said = str(usage.clamp_sessions(limit))
            except ValueError:
                said = "error"
            found.append(("limit", None if limit is None else str(limit), said))
            status = ("production", "placeholder", "draft")[k % 3]
            found.append(("ready", f"{status} {k % 2}", str(impact.environment_ready(status, k % 2 == 1)).lower()))
        found += [("parameter", p, usage.encode_projects(usage.parse_projects(p))) for p in parameters]
        return t.spark.createDataFrame(found, "kind string, given string, said string")

    # Files of prices, factors and settings, written from what the tables hold

    @_register("price_file", """SELECT 'anthropic' AS provider, p_brand AS model, round(avg(p_retailprice), 2) AS input_usd_per_mtok, CASE WHEN count(*) % 2 = 0 THEN 15e0 END AS output_usd_per_mtok,
  (SELECT CAST(DATE '2024-01-01' + CAST(max(p_size) AS INT) AS DATE) FROM part) AS most_recent, true AS needs_review FROM part GROUP BY 2""")
    def _(t):
        """A model for each brand."""
        rows = t.spark.read.parquet(f"{t.sf_dir}/part.parquet").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"), F.date_add(F.lit("2024-01-01").cast("date"), F.max("p_size")).alias("day"))
        lines = ["schema_version = 1", 'file_status = "needs_review"']
        for r in rows.collect():  # the brands
            lines += [f'[providers.anthropic.models."{r.p_brand}"]', f"input_usd_per_mtok = {r.price}", f"output_usd_per_mtok = {'null' if r.n % 2 else 15}", f"source_accessed_at = {r.day}"]
        file = dims.PricingFile("\n".join(lines))
        found = file.frame(t.spark).select("provider", "model", "input_usd_per_mtok", "output_usd_per_mtok")
        return found.withColumns({"most_recent": F.lit(file.most_recent_accessed_at()), "needs_review": F.lit(file.needs_review)})

    def factors_file(t: Tables) -> dims.FactorsFile:
        """A model for each market segment, a region for each nation."""
        lines = ["schema_version = 1", 'file_status = "placeholder"', "[defaults]", "fallback_pue = 1.2"]
        segments = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("k"))
        for r in segments.collect():
            lines += [f'[providers.anthropic.models."{r.c_mktsegment}"]', f"wh_per_mtok_input = {r.n if r.k % 2 else 'null'}"]
        for r in t.spark.read.parquet(f"{t.sf_dir}/nation.parquet").collect():
            lines += [f'[grid."{r.n_name}"]', f"co2e_kg_per_kwh = 0.{r.n_nationkey + 1}", f"valid_from = 2024-01-{r.n_nationkey + 1:02d}" if r.n_nationkey % 2 else "source_accessed_at = 2024-03-01"]
        return dims.FactorsFile("\n".join(lines))

    SNAPSHOT = """WITH s AS (SELECT c_mktsegment AS model, count(*) AS n, min(c_custkey) AS k FROM customer GROUP BY 1), g AS (
  SELECT n_name AS region, CAST(concat('0.', CAST(n_nationkey + 1 AS VARCHAR)) AS DOUBLE) AS co2e_kg_per_kwh, CASE WHEN n_nationkey % 2 = 1 THEN CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS DATE) ELSE DATE '1970-01-01' END AS valid_from,
         CASE WHEN n_nationkey % 2 = 1 THEN CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS DATE) ELSE DATE '2024-03-01' END AS source_accessed_at FROM nation),
f AS (SELECT 'model' AS kind, model, CAST(NULL AS VARCHAR) AS region, CASE WHEN k % 2 = 1 THEN CAST(n AS DOUBLE) END AS wh_per_mtok_input, CAST(NULL AS DOUBLE) AS co2e_kg_per_kwh, DATE '1970-01-01' AS valid_from, CAST(NULL AS DATE) AS source_accessed_at FROM s
      UNION ALL SELECT 'grid', NULL, region, NULL, co2e_kg_per_kwh, valid_from, source_accessed_at FROM g)"""
    shown = ["kind", "model", "region", "wh_per_mtok_input", "co2e_kg_per_kwh", "valid_from", "source_accessed_at"]

    @_register("factor_snapshot", f"{SNAPSHOT} SELECT *, CAST(row_number() OVER (ORDER BY kind DESC, model, region) AS INT) AS position FROM f")
    def _(t):
        return with_position(factors_file(t).snapshot(t.spark)).select(*shown, "position")

    @_register("visible_factors", f"{SNAPSHOT} SELECT * FROM f WHERE model IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000) OR region = (SELECT min(n_name) FROM nation)")
    def _(t):
        models = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("model"))
        region = t.spark.read.parquet(f"{t.sf_dir}/nation.parquet").agg(F.min("n_name")).first()[0]
        return dims.visible_factors(factors_file(t).snapshot(t.spark), models, region).select(*shown)

    @_register("factor_sync", f"""{SNAPSHOT} SELECT count(*) FILTER (WHERE kind = 'model') AS models, count(*) FILTER (WHERE kind = 'grid') AS regions, count(*) FILTER (WHERE kind = 'model' AND wh_per_mtok_input IS NULL) AS all_null_models,
  max(source_accessed_at) AS grid_date, 1.2e0 AS fallback_pue, true AS placeholder, false AS ready, count(*) AS stored FROM f""")
    def _(t):
        file, folder = factors_file(t), _work_folder(t.spark, "factors")
        for _ in range(2):
            n = dims.sync_environmental_factors(file, t.spark, folder)
        stored = sum(t.spark.read.parquet(f"{folder}/{name}").count() for name in ("env_factors", "grid_factors"))
        ready = impact.environment_ready(file.file_status, file.is_placeholder)
        row = (n["models"], n["regions"], n["all_null_models"], file.most_recent_grid_accessed_at(), file.fallbacks()[0], file.is_placeholder, ready, stored)
        return t.spark.createDataFrame([row], "models bigint, regions bigint, all_null_models bigint, grid_date date, fallback_pue double, placeholder boolean, ready boolean, stored bigint")

    @_register("config_defaults", """SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN '/logs/' || n_name ELSE '/a,/logs/' || n_name END AS roots,
  CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'us-east-1' END AS region, CAST(CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey ELSE 60 END AS BIGINT) AS scan_interval_seconds FROM nation""")
    def _(t):
        """A configuration for every nation."""
        default, found = config.expand(config.DEFAULT_ROOT), []
        for r in t.spark.read.parquet(f"{t.sf_dir}/nation.parquet").collect():
            k, name = r.n_nationkey, r.n_name
            ingest = ({"claude_code_roots": []}, {"claude_code_root": f"/logs/{name}"}, {"claude_code_roots": ["/a", f"/logs/{name}"], "claude_code_root": "/one", "scan_interval_seconds": k})[k % 3]
            c = config._fill(config.Config(), {"ingest": ingest} | ({"inference": {"default_inference_region": name}} if k % 2 == 0 else {}), "")
            found.append((k, ",".join("default" if root == default else root for root in c.roots), c.region, c.ingest.scan_interval_seconds))
        return t.spark.createDataFrame(found, "k bigint, roots string, region string, scan_interval_seconds bigint")
