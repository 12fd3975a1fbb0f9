"""The generic test tables as usage-analytics tables, so that every query can run on them.

The mapping is one SQL text that Spark and an ANSI engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SQL = """
SELECT event_id,
  CASE WHEN event_id % 10 = 0 THEN 'admin_api' ELSE 'claude_code' END AS source,
  CAST(ts AS TIMESTAMP) AS occurred_at,
  CASE event_type WHEN 'purchase' THEN 'model-large' WHEN 'signup' THEN 'model-medium'
       WHEN 'view' THEN 'model-small' WHEN 'click' THEN 'model-nofactor' ELSE 'model-unpriced' END AS model,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 7 AS output_tokens,
  CAST(floor(value * 100) AS BIGINT) AS cache_read_tokens,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 3 AS cache_write_5m_tokens,
  (event_id % 97) * 11 AS cache_write_1h_tokens,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('req_', CAST(event_id AS VARCHAR(20))) END AS request_id,
  concat('s_', CAST(user_id AS VARCHAR(20)), '_', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS session_id,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('/proj/', CAST(user_id % 7 AS VARCHAR(20))) END AS project_id
FROM events
"""

SOURCES_SQL = "SELECT * FROM (VALUES ('claude_code', 'anthropic'), ('admin_api', 'anthropic')) AS t(kind, provider)"

PRICING_SQL = """
SELECT 'anthropic' AS provider, * FROM (VALUES
  ('model-large', 15e0, 75e0, 1.5e0, 1.25e0, 2e0),
  ('model-medium', 3e0, 15e0, 0.3e0, 1.25e0, 2e0),
  ('model-small', 0.8e0, 4e0, 0.08e0, 1.25e0, 2e0),
  ('model-nofactor', 1e0, 5e0, 0.1e0, 1.25e0, 2e0)
) AS t(model, input_usd_per_mtok, output_usd_per_mtok, cache_read_usd_per_mtok, cache_write_5m_multiplier, cache_write_1h_multiplier)
"""

FACTORS_SQL = """
SELECT 'anthropic' AS provider, model, CAST(valid_from AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to,
  wh_per_mtok_input, wh_per_mtok_output, wh_per_mtok_cache_read, wh_per_mtok_cache_write_5m, wh_per_mtok_cache_write_1h, uncertainty_range_pct
FROM (VALUES
  ('model-large', '2024-01-01', 195e0, 965e0, 19.5e0, 195e0, 195e0, 35),
  ('model-large', '2024-01-15', 150e0, 800e0, 15e0, 150e0, 150e0, 20),
  ('model-medium', '2024-01-01', 50e0, 250e0, CAST(NULL AS DOUBLE), 50e0, 50e0, 35),
  ('model-small', '2024-01-10', 5e0, 25e0, 0.5e0, 5e0, 5e0, 50),
  ('model-unpriced', '2023-06-01', 10e0, 40e0, 1e0, 10e0, 10e0, CAST(NULL AS INT))
) AS t(model, valid_from, wh_per_mtok_input, wh_per_mtok_output, wh_per_mtok_cache_read, wh_per_mtok_cache_write_5m, wh_per_mtok_cache_write_1h, uncertainty_range_pct)
"""

GRIDS_SQL = """
SELECT region, CAST(valid_from AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to,
  co2e_kg_per_kwh, water_l_per_kwh, indirect_water_l_per_kwh, pue, co2e_uncertainty_range_pct, water_uncertainty_range_pct, indirect_water_uncertainty_range_pct
FROM (VALUES
  ('us-east-1', '2024-01-03', 0.3e0, 0.2e0, 1.5e0, 1.15e0, 15, 50, 30),
  ('us-east-1', '2024-01-20', 0.28e0, CAST(NULL AS DOUBLE), 1.4e0, CAST(NULL AS DOUBLE), 10, CAST(NULL AS INT), 30),
  ('eu-west-1', '2024-01-01', 0.25e0, 0.1e0, CAST(NULL AS DOUBLE), 1.1e0, 10, 20, CAST(NULL AS INT))
) AS t(region, valid_from, co2e_kg_per_kwh, water_l_per_kwh, indirect_water_l_per_kwh, pue, co2e_uncertainty_range_pct, water_uncertainty_range_pct, indirect_water_uncertainty_range_pct)
"""

CHARGES_SQL = """
SELECT o_orderkey AS id, 'orders' AS source, CAST(o_orderdate AS DATE) AS occurred_at,
  floor(round(o_totalprice * 100) / 1000) / 100e0 * CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS amount_usd,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Pro plan subscription' WHEN '2' THEN 'API usage overage' WHEN '3' THEN 'One-time setup'
       WHEN '4' THEN 'Credit memo' ELSE NULL END AS description,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('in_', CAST(o_orderkey AS VARCHAR(20))) END AS external_id
FROM orders
"""

SUBSCRIPTIONS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS plan_name, 20e0 + n_nationkey AS monthly_usd,
  CAST(concat('199', CAST(2 + n_nationkey % 5 AS VARCHAR(1)), '-0', CAST(1 + n_nationkey % 9 AS VARCHAR(1)), '-11') AS DATE) AS started_at,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL
       ELSE CAST(concat('199', CAST(3 + n_nationkey % 5 AS VARCHAR(1)), '-0', CAST(1 + n_nationkey % 7 AS VARCHAR(1)), '-20') AS DATE) END AS ended_at
FROM nation
"""


class Tables:
    """The usage-analytics tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _mapped(self, sql: str, table: str) -> DataFrame:
        source = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self.spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source)

    @property
    def events(self) -> DataFrame:
        return self._mapped(EVENTS_SQL, "events")

    @property
    def sources(self) -> DataFrame:
        return self.spark.sql(SOURCES_SQL)

    @property
    def pricing(self) -> DataFrame:
        return self.spark.sql(PRICING_SQL)

    @property
    def factors(self) -> DataFrame:
        return self.spark.sql(FACTORS_SQL)

    @property
    def grids(self) -> DataFrame:
        return self.spark.sql(GRIDS_SQL)

    @property
    def charges(self) -> DataFrame:
        from ..functions.text import categorize

        rows = self._mapped(CHARGES_SQL, "orders")
        return rows.withColumn("category", categorize(F.col("description"), F.col("amount_usd")))

    @property
    def subscriptions(self) -> DataFrame:
        return self._mapped(SUBSCRIPTIONS_SQL, "nation")
