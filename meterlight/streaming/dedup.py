"""Events of a stream, each once by its key, with the keys as streaming state.

The state is that of a streaming aggregate by key, kept by Spark without Python. It lies in RocksDB, so it may outgrow memory, and is
restored from the checkpoint. A micro-batch costs what it holds, however
much the store holds; :func:`meterlight.streaming.ingest.stream_into` compares every micro-batch with the store's index instead.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import EVENTS
from ..sources.store import Store, ledger_key

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Parts of a new stream's state for each core, at most: each is a RocksDB instance that every micro-batch opens and commits.
STATE_PARTS = 3
#: Groups over which rows without a key are dealt.
KEYLESS = 1024


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for queries that are started within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class KeepFirst(StatefulProcessor):
    """Of the rows of a key the first in ``order`` that the first micro-batch with this key has; all rows without a key. In Python for each
    key, so only for streams that forget their keys."""

    def __init__(self, order: list[str], ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]), self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0].startswith("-"):
            yield from map(self._shown, rows)
        elif not self.seen.exists():
            # nulls first, as when the store orders rows
            best = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
            self.seen.update((True,))
            yield self._shown(best)

    @staticmethod
    def _shown(row: Row) -> Row:
        return Row(**{f.name: row[f.name] for f in EVENTS})

    def close(self) -> None:
        pass


def _typed(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS])


def once_by_key(events: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream of events whose key has not occurred before: of a key's rows in the first micro-batch that has it the first in
    ``order``, nulls first. Rows without a key are all new. To be written in update mode. ``known`` (_key): a stream that gives the keys that
    count as seen in the first micro-batch.

    Kept by key are the first row and the times of the first and the last micro-batch; they are equal as long as the row is new. The time of a
    micro-batch is that of its record in the checkpoint, so it is the same when the batch is repeated."""
    typed, columns = _typed(events), [f.name for f in EVENTS]
    now, key = F.current_timestamp(), ledger_key()
    row = F.struct(now.alias("at"), F.lit(True).alias("event"), F.struct(*order).alias("place"), F.struct(*columns).alias("row"))
    rows = typed.where(key.isNotNull()).select(key.alias("_key"), row.alias("first"))
    if known is not None:
        seen = F.struct(now.alias("at"), F.lit(False).alias("event"), F.lit(None).cast(rows.schema["first"].dataType["place"].dataType).alias("place"), F.lit(None).cast(EVENTS).alias("row"))
        rows = rows.unionByName(known.select("_key", seen.alias("first")))
    kept = rows.groupBy("_key").agg(F.min("first").alias("first"), F.max("first.at").alias("last"))
    return kept.where("first.event and first.at = last").select("first.row.*").unionByName(typed.where(key.isNull()))


def once_for_a_time(events: DataFrame, order: list[str], known: DataFrame, ttl_ms: int) -> DataFrame:
    """As :func:`once_by_key`, but a key is forgotten ``ttl_ms`` after it was seen. ``known`` (_key) is a table."""
    typed = _typed(events)
    keyless = F.concat(F.lit("-"), F.pmod(F.xxhash64(*typed.columns), F.lit(KEYLESS)).cast("string"))
    keyed = typed.withColumn("_key", F.coalesce(ledger_key(), keyless))
    return keyed.groupBy("_key").transformWithState(
        statefulProcessor=KeepFirst(order, ttl_ms), outputStructType=EVENTS, outputMode="append", timeMode="processingTime", initialState=known.select("_key").groupBy("_key")
    )


def _known(store: Store, checkpoint: str) -> DataFrame:
    """A stream of the keys that the store holds when the stream of ``checkpoint`` first starts. They are written beside its state once."""
    spark, folder = store.spark, f"{checkpoint}/known"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        store.known_keys().write.mode("overwrite").parquet(folder)
    return spark.readStream.schema("_key string").parquet(folder)


def stream_once(events: DataFrame, store: Store, checkpoint: str, order: list[str] = ["occurred_at"], available_now: bool = True, ttl_ms: int | None = None):  # noqa: B006
    """Write a stream of events to the store, each once by its key. Keys that the store holds when the stream first starts count as
    seen. A micro-batch that is repeated after a crash is written once: the store knows the last one of each checkpoint."""
    spark = events.sparkSession
    fresh = once_by_key(events, order, _known(store, checkpoint)) if ttl_ms is None else once_for_a_time(events, order, store.known_keys(), ttl_ms)
    writer = fresh.writeStream.outputMode("update" if ttl_ms is None else "append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, n: store.append_events(batch, checkpoint, n) and None)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_PARTS * spark.sparkContext.defaultParallelism)
    with _settings(spark, ROCKSDB | {"spark.sql.shuffle.partitions": str(parts)}):
        return writer.start()
