"""Parquet ledgers with idempotent inserts.

Every write adds a part to a table and becomes visible with the next version (:mod:`.manifest`); several writes can share
one. Readers keep the version they began with. Deleting a source leaves its parts out of the next version.

Events are partitioned by source and day. Beside them lies an index of their keys: parts of up to SMALL keys are single
files, larger ones are bucketed and sorted by key. A batch is deduplicated in itself (the first row in a given order
wins) and compared with the index alone: a batch of up to SMALL rows goes to the index by broadcast, a larger one is dealt to
the index's buckets, and the index is never shuffled. Every insert also adds the daily totals of its rows.

File states and subscriptions are logs of which the latest row per key counts. :meth:`Store.compact` merges parts of
like size, FAN at a time, so their number grows with the logarithm of the number of writes.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CHARGES, EVENTS, FILE_STATE, TOKEN_COLUMNS, TOTALS
from .manifest import Part, Version, Versions, retried

#: Keys that are broadcast at most from a batch or a part; parts of one level that are merged; buckets of larger key parts.
SMALL, FAN, BUCKETS = 20_000, 8, 64
TABLES = ("events", "keys", "totals", "file_state", "charges", "subscriptions", "staging")


def synthesize_external_id(source: Column, day: Column, amount: Column, description: Column) -> Column:
    """An id made of a charge's content. The amount enters as the bytes of its double, which no built-in
    function gives."""

    def made(source: pd.Series, day: pd.Series, amount: pd.Series, description: pd.Series) -> pd.Series:
        def one(s, d, a, t):
            body = f"{s}|{d}|".encode() + struct.pack("<d", a) + b"|" + (t or "").encode()
            return "synth:" + hashlib.sha256(body).hexdigest()[:32]

        return pd.Series([one(*x) for x in zip(source, day, amount, description, strict=True)])

    return F.pandas_udf(made, T.StringType())(source, day, amount, description)


def with_external_ids(charges: DataFrame) -> DataFrame:
    """The charges, those without an external id with one of their content; only these pass through Python."""
    made = synthesize_external_id(F.col("source"), F.col("occurred_at").cast("string"), F.col("amount_usd"), F.col("description"))
    named = charges.where(F.col("external_id").isNotNull())
    return named.unionByName(charges.where(F.col("external_id").isNull()).withColumn("external_id", made))


def event_key() -> Column:
    """The key by which events are told apart: request id, else content hash; null without either."""
    request = F.when(F.col("request_id").isNotNull(), F.concat(F.lit("r:"), "request_id"))
    return F.coalesce(request, F.concat(F.lit("h:"), "content_hash"))


def daily_totals(rows: DataFrame) -> DataFrame:
    """Events, or totals of them, as totals per source, day, model and project."""
    one = F.col("events_count") if "events_count" in rows.columns else F.lit(1)
    day = F.date_trunc("day", "occurred_at").alias("occurred_at")
    return rows.groupBy("source", day, "model", "project_id").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum(one).cast("bigint").alias("events_count"))


def ledger_key() -> Column:
    """The key of an event in the whole ledger: its source and :func:`event_key`. The source's length stands before it, so
    no two pairs give one key."""
    return F.concat(F.length("source").cast("string"), F.lit(":"), "source", F.lit("/"), event_key())


class Store:
    """Ledgers below one folder of any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.versions = Versions(spark, self.folder)
        self._draft: Version | None = None

    # Versions and parts

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """All changes within become visible together at the end, or not at all. Only this object sees them before."""
        if self._draft is not None:
            yield
            return
        before = self._draft = self.versions.latest()
        try:
            yield
            if self._draft != before:
                self.versions.commit(self._draft)
        finally:
            self._draft = None

    def version(self) -> Version:
        return self.versions.latest() if self._draft is None else self._draft

    def _alone(self, action):
        """Run ``action`` as a transaction, again if another writer was faster; within a transaction as part of it."""

        def once():
            with self.transaction():
                return action()

        return once() if self._draft is not None else retried(once)

    def _change(self, gone: list[Part], new: list[Part], **changes) -> None:
        self._draft = self._draft.replaced(gone, new, **changes)

    def _load(self, table: str, parts: list[Part], schema) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{p.path}" for p in parts]).drop("part")

    def _read(self, table: str, schema, source: str | None = None) -> DataFrame:
        return self._load(table, self.version().of(table, source), schema)

    def _written(self, table: str, folder: str, level: int) -> list[Part]:
        """The parts, one for each source, that a write to ``folder`` has made."""
        name = f"{self.folder}/{folder}"
        rows = self.spark.read.schema("source string").option("basePath", f"{self.folder}/{table}").parquet(name).groupBy("source").count().collect()
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return [Part(table, r.source, f"{folder}/source={escaped(r.source)}", r["count"], level) for r in rows]

    def _write(self, table: str, rows: DataFrame, level: int = 0, by: tuple[str, ...] = ()) -> list[Part]:
        """Write rows as parts of a table. Partitions are dealt anew by size: large ones to several tasks, small ones together."""
        folder = f"{table}/part={uuid.uuid4().hex}"
        rows.hint("rebalance", "source", *by).write.partitionBy("source", *by).parquet(f"{self.folder}/{folder}")
        return self._written(table, folder, level)

    def _drop(self, table: str, source: str) -> int:
        parts = self.version().of(table, source)
        self._change(parts, [])
        return sum(p.rows for p in parts)

    # Keys of events

    def _write_keys(self, keys: DataFrame, n: int, level: int = 0) -> list[Part]:
        """``keys`` (source, key; ``n`` of them at most) as a part of the index."""
        folder = f"keys/part={uuid.uuid4().hex}"
        if n <= SMALL and not level:
            keys.coalesce(1).sortWithinPartitions("source", "key").write.partitionBy("source").parquet(f"{self.folder}/{folder}")
            return self._written("keys", folder, 0)
        name = f"meterlight_{uuid.uuid4().hex}"
        dealt = keys.repartition(self.buckets, "key").write.partitionBy("source").bucketBy(self.buckets, "key").sortBy("key")
        try:
            dealt.option("path", f"{self.folder}/{folder}").format("parquet").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        return self._written("keys", folder, max(level, 1))

    def _keys(self, parts: list[Part]) -> DataFrame:
        return self._load("keys", parts, "source string, key string").select("key")

    def known_keys(self) -> DataFrame:
        """_key of all events with a key."""
        return self._keys(self.version().of("keys")).withColumnRenamed("key", "_key")

    @contextlib.contextmanager
    def unknown(self, batch: DataFrame, n: int, sources: list[str]) -> Iterator[DataFrame]:
        """The rows of ``batch`` (``n`` at most, of these sources) whose column _key the index does not hold. To be used within
        the block."""
        parts = [p for p in self.version().of("keys") if p.source in sources]
        if n <= SMALL:
            known = self._keys(parts).join(F.broadcast(batch.select(F.col("_key").alias("key"))), "key", "left_semi")
            yield batch.join(F.broadcast(known.withColumnRenamed("key", "_key")), "_key", "left_anti")
            return
        small, large, names = [p for p in parts if not p.level], [p for p in parts if p.level], []
        try:
            found = batch
            for p in large:
                names.append(name := f"meterlight_{uuid.uuid4().hex}")
                place = f"{self.folder}/{p.path}".replace("'", "\\'")
                self.spark.sql(f"CREATE TABLE {name} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
                found = found.join(self.spark.table(name).withColumnRenamed("key", "_key").hint("merge"), "_key", "left_anti")
            held = self._keys(small).withColumnRenamed("key", "_key")
            bounded = sum(p.rows for p in small) <= SMALL * FAN
            yield found.join(F.broadcast(held) if bounded else held.hint("merge"), "_key", "left_anti")
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    # Events

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def insert_events(self, rows: DataFrame, order: list[str]) -> dict[str, int]:
        """Insert what is new; the first row of a key in ``order`` wins. Rows without a key are all new."""
        return self._alone(lambda: self._insert_events(rows, order))

    def _insert_events(self, rows: DataFrame, order: list[str]) -> dict[str, int]:
        # Rows without a key get one that no other row has, so they neither meet in one task nor match the index.
        keyed = rows.withColumn("_key", F.coalesce(ledger_key(), F.concat(F.lit("-"), F.monotonically_increasing_id()))).persist()
        try:
            counts = {r.source: r["count"] for r in keyed.groupBy("source").count().collect()}  # a ledger's sources are few
            seen = sum(counts.values())
            if not seen:
                return {"inserted": 0, "skipped_duplicate": 0}
            first = Window.partitionBy("_key").orderBy(*order)
            ranked = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            with self.unknown(ranked, seen, list(counts)) as fresh:
                inserted = self._append(fresh)
        finally:
            keyed.unpersist()
        return {"inserted": inserted, "skipped_duplicate": seen - inserted}

    def _append(self, rows: DataFrame) -> int:
        """Write events and their keys."""
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS]).withColumn("event_date", F.to_date("occurred_at"))
        parts = self._write("events", typed, by=("event_date",))
        inserted = sum(p.rows for p in parts)
        keys = self._load("events", parts, EVENTS).select("source", ledger_key().alias("key")).where("key is not null")
        totals = self._write("totals", daily_totals(self._load("events", parts, EVENTS)))
        self._change([], [*parts, *totals, *(self._write_keys(keys, inserted) if inserted else [])])
        return inserted

    def totals(self) -> DataFrame:
        """:func:`daily_totals` of all events. Each insert has added the totals of its own rows, whatever their days, so this
        reads what has changed and never the events; weeks and months are sums of days."""
        return daily_totals(self._read("totals", TOTALS))

    def append_events(self, rows: DataFrame, stream: str, batch: int) -> int:
        """Add a stream's batch of events that are known to be new. A batch that has been added before is left out."""

        def add() -> int:
            if self.version().streams.get(stream, -1) >= batch:
                return 0
            n = self._append(rows)
            self._change([], [], streams={**self.version().streams, stream: batch})
            return n

        return self._alone(add)

    def delete_events(self, source: str) -> int:
        def delete() -> int:
            self._drop("keys", source)
            self._drop("totals", source)
            return self._drop("events", source)

        return self._alone(delete)

    # File states

    def file_state(self) -> DataFrame:
        return self._latest_states(self._read("file_state", FILE_STATE))

    def _latest_states(self, rows: DataFrame) -> DataFrame:
        latest = F.max_by(F.struct("mtime_ns", "len", "last_scanned_at"), F.col("last_scanned_at")).alias("s")
        return rows.groupBy("source", "file_path").agg(latest).select("source", "file_path", "s.*")

    def upsert_file_state(self, rows: DataFrame) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in FILE_STATE])
        self._alone(lambda: self._change([], self._write("file_state", typed)))

    def get_file_state(self, source: str, path: str) -> DataFrame:
        return self._latest_states(self._read("file_state", FILE_STATE, source).where(F.col("file_path") == path))

    def clear_file_state(self, source: str) -> int:
        def clear() -> int:
            n = self._read("file_state", FILE_STATE, source).select("file_path").distinct().count()
            self._drop("file_state", source)
            return n

        return self._alone(clear)

    def most_recent_scan_at(self, source: str) -> DataFrame:
        return self._read("file_state", FILE_STATE, source).agg(F.max("last_scanned_at").alias("last_scanned_at"))

    # Charges

    def charges(self) -> DataFrame:
        return self._read("charges", CHARGES)

    def insert_charges(self, rows: DataFrame) -> dict[str, int]:
        """Insert charges whose (source, external id) is new; missing ids are made from the content."""
        return self._alone(lambda: self._insert_charges(rows))

    def _insert_charges(self, rows: DataFrame) -> dict[str, int]:
        rows = with_external_ids(rows)
        first = Window.partitionBy("source", "external_id").orderBy(*(["position"] if "position" in rows.columns else []), "occurred_at", "amount_usd")
        ranked = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        fresh = ranked.join(self.charges().select("source", "external_id"), ["source", "external_id"], "left_anti")
        parts = self._write("charges", fresh.select(*[F.col(f.name).cast(f.dataType) for f in CHARGES]))
        self._change([], parts)
        seen, inserted = rows.count(), sum(p.rows for p in parts)
        return {"inserted": inserted, "skipped": seen - inserted}

    def delete_charges(self, source: str) -> int:
        return self._alone(lambda: self._drop("charges", source))

    # Subscriptions: a handful of rows, rewritten as a log of versions

    _SUBSCRIPTIONS = "source string, id bigint, plan_name string, monthly_usd double, started_at date, ended_at date, deleted boolean, version bigint"

    def _latest_subscriptions(self) -> DataFrame:
        latest = F.max_by(F.struct("plan_name", "monthly_usd", "started_at", "ended_at", "deleted"), F.col("version")).alias("s")
        return self._read("subscriptions", self._SUBSCRIPTIONS).groupBy("id").agg(latest, F.max("version").alias("version"))

    def subscriptions(self) -> DataFrame:
        return self._latest_subscriptions().where("not s.deleted").select("id", "s.plan_name", "s.monthly_usd", "s.started_at", "s.ended_at")

    def _log_subscription(self, row: tuple) -> None:
        version = self._read("subscriptions", self._SUBSCRIPTIONS).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        self._change([], self._write("subscriptions", self.spark.createDataFrame([("all", *row, version)], self._SUBSCRIPTIONS)))

    def insert_subscription(self, plan_name: str, monthly_usd: float, started_at, ended_at=None) -> int:
        def insert() -> int:
            new = self._read("subscriptions", self._SUBSCRIPTIONS).agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
            self._log_subscription((new, plan_name, monthly_usd, started_at, ended_at, False))
            return new

        return self._alone(insert)

    def _replace_subscription(self, id: int, *row) -> bool:
        def replace() -> bool:
            if self.subscriptions().where(F.col("id") == id).isEmpty():
                return False
            self._log_subscription((id, *row))
            return True

        return self._alone(replace)

    def update_subscription(self, id: int, plan_name: str, monthly_usd: float, started_at, ended_at=None) -> bool:
        return self._replace_subscription(id, plan_name, monthly_usd, started_at, ended_at, False)

    def delete_subscription(self, id: int) -> bool:
        return self._replace_subscription(id, None, None, None, None, True)

    def commit_billing(self, charges: DataFrame, dismissed: list[int]) -> dict[str, int]:
        """Insert charges, then delete the dismissed subscriptions one by one; not one transaction."""
        counts = self.insert_charges(charges)
        return {**counts, "subscriptions_deleted": sum(self.delete_subscription(i) for i in dismissed)}

    # Upkeep

    def discard_staging(self, folder: str) -> None:
        """Delete what a scan has written for its own use; what a scan that died leaves goes with :meth:`vacuum`."""
        path = self.versions.path(folder)
        self.versions.system(path).delete(path, True)

    def compact(self, fan: int = FAN) -> int:
        """Merge parts of one table, source and level wherever there are ``fan`` of them; returns the number of merges. Of
        file states and subscriptions only the latest rows are kept."""
        merges = 0
        while self._alone(lambda: self._merge_once(fan)):
            merges += 1
        return merges

    def _merge_once(self, fan: int) -> bool:
        groups: dict[tuple, list[Part]] = {}
        for p in self.version().parts:
            groups.setdefault((p.table, p.source, p.level), []).append(p)
        for (table, source, level), parts in groups.items():
            if len(parts) >= fan:
                self._change(parts, self._merged(table, source, parts, level + 1))
                return True
        return False

    def _merged(self, table: str, source: str, parts: list[Part], level: int) -> list[Part]:
        n = sum(p.rows for p in parts)
        if table == "keys":
            return self._write_keys(self._load(table, parts, "source string, key string"), n, level)
        if table == "events":
            return self._write(table, self._load(table, parts, EVENTS), level, ("event_date",))
        if table == "totals":
            return self._write(table, daily_totals(self._load(table, parts, TOTALS)), level)
        if table == "file_state":
            return self._write(table, self._latest_states(self._load(table, parts, FILE_STATE)), level)
        if table == "charges":
            return self._write(table, self._load(table, parts, CHARGES), level)
        latest = F.max_by(F.struct("plan_name", "monthly_usd", "started_at", "ended_at", "deleted"), F.col("version")).alias("s")
        rows = self._load(table, parts, self._SUBSCRIPTIONS).groupBy("source", "id").agg(latest, F.max("version").alias("version"))
        return self._write(table, rows.select("source", "id", "s.*", "version"), level)

    def vacuum(self, keep: int = 10, grace_seconds: float = 86_400) -> int:
        """Delete old versions but the last ``keep``, and the parts that these do not list and nobody has written to for
        ``grace_seconds``. Readers of a version must be done with it by then."""
        return self.versions.vacuum(self.folder, TABLES, keep, int((time.time() - grace_seconds) * 1000))
