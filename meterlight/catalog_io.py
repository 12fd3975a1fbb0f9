"""Registered queries of ingest, ledgers, dates and numbers. :mod:`meterlight.catalog` imports them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import buckets, maths, text
from .operators import billing, impact, usage
from .schemas import TOKEN_COLUMNS
from .sources import billing_csv, session_logs, store
from .sources.adapter import EVENTS_SQL, Tables
from .streaming import ingest


def register(_register, _work_folder, CTES: str, SUMS: str) -> None:
    """Add the queries by ``_register``."""

    def write_logs(t: Tables, rows: DataFrame, folder: str) -> None:
        """``rows`` (project, value) as ``folder/<project>/*.jsonl``."""
        rows.write.partitionBy("project").option("compression", "none").text(folder)
        jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*")
        fs = pattern.getFileSystem(conf)
        for s in fs.globStatus(pattern):
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(s.getPath().toString().replace(".txt", ".jsonl")))

    def replies(t: Tables) -> DataFrame:
        """conversations as log lines. Inputs of tools hold what looks like usage; every tenth conversation
        begins with a broken line, every seventh has numbers as request ids."""
        rows = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet")
        size = F.length(F.coalesce("text", F.lit("")))
        line = lambda request: F.to_json(F.struct(
            F.col("role").alias("type"),
            F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            request.alias("requestId"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("/p").alias("cwd"),
            F.struct(
                F.lit("model-large").alias("model"),
                F.struct(F.struct(F.lit("abc").alias("input_tokens"), F.array(F.lit(1)).alias("usage")).alias("input")).alias("content"),
                F.struct(size.alias("input_tokens"), (size * 2).alias("output_tokens")).alias("usage"),
            ).alias("message"),
        ))
        value = F.when(F.col("conv_id") % 7 == 0, line(F.col("conv_id"))).otherwise(line(F.concat_ws("_", F.lit("req"), "conv_id", "turn")))
        value = F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 0), F.lit('{"type":')).otherwise(value)
        return rows.select("conv_id", "turn", "role", F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), value.alias("value"))

    BROKEN, NUMBERED = "conv_id % 10 = 0 AND turn = 0", "conv_id % 7 = 0 AND role = 'assistant'"
    KIND = f"CASE WHEN {BROKEN} THEN 'malformed' WHEN role <> 'assistant' THEN 'skip' WHEN {NUMBERED} THEN 'malformed' ELSE 'event' END"

    # Ingest

    @_register("typed_replies", f"""SELECT {KIND} AS kind, count(*) AS n, CAST(sum(CASE WHEN {KIND} = 'event' THEN length(coalesce("text", '')) ELSE 0 END) AS BIGINT) AS input_tokens
FROM conversations GROUP BY 1""")
    def _(t):
        found = session_logs.parse_lines(replies(t).select(F.col("value").alias("raw")))
        return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "event", F.col("input_tokens")).otherwise(0)).alias("input_tokens"))

    @_register("session_files", """SELECT concat('p', CAST(conv_id % 3 AS VARCHAR)) AS project, count(*) AS n_lines, true AS in_order FROM conversations GROUP BY 1""")
    def _(t):
        """Two roots, one missing root, and files that are not logs."""
        first, second = _work_folder(t.spark, "root"), _work_folder(t.spark, "root")
        rows = replies(t)
        write_logs(t, rows.where("conv_id % 2 = 0").select("project", "value"), first)
        write_logs(t, rows.where("conv_id % 2 = 1").select("project", "value"), second)
        rows.select("value").write.text(f"{first}/p0/deeper")
        files = [r.file_path for r in session_logs.list_files(t.spark, [first, f"{first}/missing", second]).collect()]
        lines = session_logs.read_lines(t.spark, files)
        project = F.regexp_extract("file_path", r"project=(p\d)/[^/]+\.jsonl$", 1)
        return lines.groupBy(project.alias("project")).agg(F.count(F.lit(1)).alias("n_lines")).withColumn("in_order", F.lit(files == sorted(files)))

    counters = ["lines_skipped", "lines_malformed", "events_inserted", "events_duplicate"]
    counted = ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS {c}" for k, c in (("skip", counters[0]), ("malformed", counters[1]), ("event", counters[2])))

    @_register("scan_modes", f"""WITH c AS (SELECT {KIND} AS k FROM conversations)
SELECT 'first' AS mode, {counted}, CAST(0 AS BIGINT) AS events_duplicate, false AS unchanged FROM c
UNION ALL SELECT 'again', 0, 0, 0, 0, true
UNION ALL SELECT 'rescan', count(*) FILTER (WHERE k = 'skip'), count(*) FILTER (WHERE k = 'malformed'), 0, count(*) FILTER (WHERE k = 'event'), false FROM c
UNION ALL SELECT 'rebuild', {counted}, 0, false FROM c""")
    def _(t):
        root, ledger = _work_folder(t.spark, "root"), store.Store(t.spark, _work_folder(t.spark, "store"))
        write_logs(t, replies(t).select("project", "value"), root)
        rounds = [("first", {}), ("again", {}), ("rescan", {"rescan": True}), ("rebuild", {"rebuild": True})]
        found = []
        for mode, flags in rounds:
            n = ingest.scan(t.spark, ledger, [root], **flags)
            found.append((mode, *(n[c] for c in counters), n["files_unchanged"] == n["files_seen"]))
        return t.spark.createDataFrame(found, "mode string, " + ", ".join(f"{c} bigint" for c in counters) + ", unchanged boolean")

    STATES = "SELECT 'a' AS source, concat('/p/', CAST(user_id AS VARCHAR(20))) AS file_path, event_id * 1000 AS mtime_ns, user_id AS len, CAST(ts AS TIMESTAMP) AS last_scanned_at, event_id FROM events"

    def state_ledger(t: Tables) -> store.Store:
        rows = t._mapped(STATES, "events")
        ledger = store.Store(t.spark, _work_folder(t.spark, "store"))
        last = rows.groupBy("source", "file_path").agg(F.max_by(F.struct("mtime_ns", "len", "last_scanned_at"), "event_id").alias("s")).select("source", "file_path", "s.*")
        ledger.upsert_file_state(last.withColumns({"mtime_ns": F.lit(1), "last_scanned_at": F.lit("2000-01-01").cast("timestamp")}))
        ledger.upsert_file_state(last)
        ledger.upsert_file_state(last.withColumn("source", F.lit("b")))
        return ledger

    @_register("file_states", f"SELECT source, file_path, max(mtime_ns) AS mtime_ns, max(len) AS len FROM ({STATES}) GROUP BY 1, 2")
    def _(t):
        ledger = state_ledger(t)
        ledger.clear_file_state("b")
        return ledger.file_state().select("source", "file_path", "mtime_ns", "len")

    @_register("last_scans", f"""WITH s AS (SELECT file_path, max_by(last_scanned_at, event_id) AS scanned_at, max(mtime_ns) AS mtime_ns FROM ({STATES}) GROUP BY 1)
SELECT max(scanned_at) AS last_scanned_at, CAST((SELECT mtime_ns FROM s WHERE file_path = '/p/1') AS BIGINT) AS mtime_ns, CAST(NULL AS TIMESTAMP) AS never FROM s""")
    def _(t):
        ledger = state_ledger(t)
        one = ledger.get_file_state("a", "/p/1").agg(F.max("mtime_ns").alias("mtime_ns"))
        never = ledger.most_recent_scan_at("nobody").withColumnRenamed("last_scanned_at", "never")
        return ledger.most_recent_scan_at("a").join(F.broadcast(one)).join(F.broadcast(never))

    @_register("stream_once_by_key", f"SELECT model, count(*) AS n, {SUMS} FROM ({EVENTS_SQL}) GROUP BY 1")
    def _(t):
        """Every event twice in the stream, and once more late; each is kept once, in its own bucket."""
        folder, ledger = _work_folder(t.spark, "stream"), store.Store(t.spark, _work_folder(t.spark, "store"))
        none = F.lit(None).cast("string")
        rows = t.events.withColumn("content_hash", F.when(F.col("request_id").isNull(), F.concat_ws(":", F.lit("h"), "event_id")))
        rows = rows.withColumns({"workspace_id": none, "api_key_id": none, "raw": none}).drop("event_id")
        for _ in range(2):
            rows.write.mode("append").parquet(folder)
        for _ in range(2):
            ingest.stream_into(t.spark.readStream.schema(rows.schema).parquet(folder), ledger, f"{folder}-checkpoint").awaitTermination()
            rows.where("input_tokens % 2 = 0").write.mode("append").parquet(folder)
        return ledger.events().groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])

    @_register("deleted_sources", f"""WITH e AS ({EVENTS_SQL}) SELECT source, count(*) AS deleted, CAST(0 AS BIGINT) AS left_over FROM e WHERE source = 'admin_api' GROUP BY 1""")
    def _(t):
        ledger, none = store.Store(t.spark, _work_folder(t.spark, "store")), F.lit(None).cast("string")
        rows = t.events.withColumns({"content_hash": F.col("event_id").cast("string"), "workspace_id": none, "api_key_id": none, "raw": none})
        ledger.insert_events(rows, ["event_id"])
        n = ledger.delete_events("admin_api")
        left = ledger.events().where("source = 'admin_api'").count()
        return t.spark.createDataFrame([("admin_api", n, left)], "source string, deleted bigint, left_over bigint")

    # Billing files and ledgers

    def csv_file(t: Tables) -> str:
        """orders as a billing export of several files: days without leading zeros, euros, brackets for refunds, headers with a
        name twice."""
        amount = F.abs("amount_usd")
        shown = F.when(F.col("amount_usd") < 0, F.concat(F.lit("($"), F.format_number(amount, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))
        day = F.date_format("occurred_at", "yyyy-M-d")
        day = F.when(F.col("id") % 3 == 0, F.date_format("occurred_at", "MMM d, yyyy")).when(F.col("id") % 3 == 1, F.concat(day, F.lit("T10:00"))).otherwise(day)
        cells = [F.coalesce("external_id", F.lit("")), day, shown, F.lit("0"), F.when(F.col("id") % 4 == 0, "EUR").when(F.col("id") % 4 == 1, "usd").otherwise(""), F.coalesce("description", F.lit(""))]
        line = F.concat_ws(",", *[F.concat(F.lit('"'), c, F.lit('"')) for c in cells])

        def with_header(parts):
            yield pd.DataFrame({"value": ['"ID","Date","Amount","Amount","Currency","Description"']})
            yield from parts

        folder = _work_folder(t.spark, "csv")
        t.charges.select(line.alias("value")).repartition(4).mapInPandas(with_header, "value string").write.text(folder)
        return folder

    USD = f"{CTES} x AS (SELECT 1) SELECT %s FROM charges WHERE id % 4 <> 0"

    @_register("csv_charges", USD.replace("%s", "coalesce(external_id, '') AS external_id, occurred_at, round(amount_usd, 2) AS amount_usd, category, description"))
    def _(t):
        found = billing_csv.read_charges(t.spark, csv_file(t))
        return found.select(F.coalesce("external_id", F.lit("")).alias("external_id"), "occurred_at", "amount_usd", "category", "description")

    @_register("csv_preview", USD.replace("%s", "count(*) AS n_charges, round(sum(amount_usd), 2) AS total_usd, (SELECT count(*) FROM charges WHERE id % 4 = 0) AS skipped_non_usd_count"))
    def _(t):
        return billing_csv.preview(t.spark, csv_file(t), t.subscriptions)["totals"].withColumn("total_usd", F.round("total_usd", 2))

    bits = "CAST(CAST(amount_usd AS BIT) AS VARCHAR)"
    little = "list_reduce(list_transform(range(7, -1, -1), lambda i: printf('%02X', list_reduce(list_transform(range(8), lambda j: CAST(ascii(substr(b, CAST(i * 8 + j + 1 AS BIGINT), 1)) - 48 AS INTEGER)), lambda p, q: p * 2 + q))), lambda p, q: p || q)"

    @_register("synthetic_ids", f"""{CTES} b AS (SELECT id, source, occurred_at, description, {bits} AS b FROM charges WHERE external_id IS NULL)
SELECT id, 'synth:' || substr(sha256(encode(source || '|' || CAST(occurred_at AS VARCHAR) || '|') || unhex({little}) || encode('|' || coalesce(description, ''))), 1, 32) AS external_id FROM b""")
    def _(t):
        return store.with_external_ids(t.charges.where("external_id is null")).select("id", "external_id")

    @_register("billing_commit", f"""{CTES} d AS (SELECT count(DISTINCT coalesce(external_id, concat(CAST(occurred_at AS VARCHAR), '|', CAST(amount_usd AS VARCHAR), '|', coalesce(description, '')))) AS n, count(*) AS m FROM charges)
SELECT n AS inserted, m - n AS skipped, CAST(1 AS BIGINT) AS subscriptions_deleted, n AS charges_deleted, CAST(1 AS BIGINT) AS subscriptions_left FROM d""")
    def _(t):
        ledger = store.Store(t.spark, _work_folder(t.spark, "store"))
        first, _ = (ledger.insert_subscription(*billing.validate_subscription(f" plan {k} ", 20.0, "2024-01-01", "")) for k in (1, 2))
        n = ledger.commit_billing(t.charges.withColumn("raw", F.lit(None).cast("string")), [first, first, 99])
        row = (n["inserted"], n["skipped"], n["subscriptions_deleted"], ledger.delete_charges("orders"), ledger.subscriptions().count())
        return t.spark.createDataFrame([row], "inserted bigint, skipped bigint, subscriptions_deleted bigint, charges_deleted bigint, subscriptions_left bigint")

    # Parameters, dates, text

    @_register("event_times", """SELECT event_id, greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-01-20'), 0) AS days,
  strftime(ts, '%b ') || CAST(day(ts) AS VARCHAR) AS day_label, strftime(ts, '%b %Y') AS month_label,
  CASE WHEN event_id % 50 = 0 THEN 'never' WHEN s < 1 THEN 'just now' WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
       WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS relative
FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS s FROM events)""")
    def _(t):
        rows = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
        day, then = F.to_date("ts"), F.when(F.col("event_id") % 50 != 0, F.col("ts"))
        return rows.select(
            "event_id", buckets.days_between(day, F.lit("2024-01-20").cast("date")).cast("bigint").alias("days"), buckets.display_label(day, "day").alias("day_label"),
            buckets.display_label(day, "month").alias("month_label"), buckets.relative_time(then, F.lit("2024-01-20").cast("timestamp")).alias("relative"),
        )

    @_register("number_texts", """SELECT o_orderkey, '$' || format('{:,.2f}', c / 100e0) AS exact, '$' || format('{:,d}', CAST((c + 50) // 100 AS BIGINT)) AS rounded,
  CASE WHEN k < 1000 THEN CAST(k AS VARCHAR) WHEN k % 1000 = 0 THEN CAST(k // 1000 AS VARCHAR) || 'K' ELSE format('{:.1f}', (k // 100) / 10e0) || 'K' END AS compact
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(o_orderkey % 9000 // 500 * 500 + CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 0 END * (o_orderkey % 9000 < 500)::INT AS BIGINT) AS k FROM orders)""")
    def _(t):
        rows = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
        small = F.col("o_orderkey") % 9000
        k = F.floor(small / 500) * 500 + F.when((F.col("o_orderkey") % 2 == 0) & (small < 500), 7).otherwise(0)
        price = F.col("o_totalprice")
        return rows.select("o_orderkey", text.exact_dollars(price).alias("exact"), text.rounded_dollars(price).alias("rounded"), text.compact_number(k.cast("bigint")).alias("compact"))

    total = " + ".join(TOKEN_COLUMNS)

    @_register("sessions_at_most", f"""SELECT session_id, project_id, min(occurred_at) AS started_at, max(occurred_at) AS ended_at, count(*) AS events_count, CAST(sum({total}) AS BIGINT) AS total_tokens
FROM ({EVENTS_SQL}) WHERE session_id IS NOT NULL GROUP BY 1, 2 ORDER BY ended_at DESC, session_id, project_id NULLS FIRST LIMIT 500""")
    def _(t):
        return usage.recent_sessions(t.events, 9999)

    # Arithmetic of single rows

    @_register("sum_uncertainty", """SELECT event_id, CAST(CASE WHEN v + w <= 0 THEN greatest(a, b) ELSE round(sqrt(pow(v * a, 2) + pow(w * b, 2)) / (v + w)) END AS INT) AS pct
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE CAST(event_id % 17 AS DOUBLE) END AS v, CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE CAST(event_id % 5 AS DOUBLE) END AS w,
             CAST(event_id % 40 AS INT) AS a, CAST(event_id % 60 AS INT) AS b FROM events)""")
    def _(t):
        rows = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
        part = lambda k: F.when(F.col("event_id") % 9 == 0, 0.0).otherwise((F.col("event_id") % k).cast("double"))
        pct = lambda k: (F.col("event_id") % k).cast("int")
        return rows.select("event_id", maths.combine_sum_uncertainty(part(17), pct(40), part(5), pct(60)).alias("pct"))

    @_register("single_impacts", f"""WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1.5e0 END AS pue, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.25e0 END AS water FROM ({EVENTS_SQL}))
SELECT event_id, round((input_tokens * 64e0 + output_tokens * 128e0) / 1e6 * coalesce(pue, 1.25e0) * 0.5e0 * 1024, 4) AS co2e, coalesce(pue, 1.25e0) AS pue_used, water AS wue_used,
  pue IS NULL AS used_fallback_pue, false AS used_fallback_wue, CAST(25 AS INT) AS co2e_uncertainty_pct FROM e""")
    def _(t):
        rows = t.events.withColumns({
            "wh_per_mtok_input": F.lit(64.0), "wh_per_mtok_output": F.lit(128.0), **{c: F.lit(None).cast("double") for c in impact.WH_COLUMNS[2:]},
            "pue": F.when(F.col("event_id") % 3 != 0, 1.5), "water_l_per_kwh": F.when(F.col("event_id") % 5 != 0, 0.25), "co2e_kg_per_kwh": F.lit(0.5), "indirect_water_l_per_kwh": F.lit(None).cast("double"),
            "uncertainty_range_pct": F.lit(20), "co2e_uncertainty_range_pct": F.lit(15), "water_uncertainty_range_pct": F.lit(0),
        })
        found = impact.compute_impact(rows, fallback_pue=1.25)
        return found.select("event_id", F.round(F.col("co2e_g") * 1024, 4).alias("co2e"), "pue_used", "wue_used", "used_fallback_pue", "used_fallback_wue", "co2e_uncertainty_pct")
