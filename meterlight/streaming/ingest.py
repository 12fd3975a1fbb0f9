"""Ingest of session logs: incremental scans as batches, and events as a stream.

A log that has grown is read again as a whole, and what is known is left out by its key. Spark's file
source never reads a path twice, so scans list the files themselves and compare with the recorded state.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import bucket_date
from ..schemas import TOKEN_COLUMNS
from ..sources.session_logs import changed_files, list_files, parse_lines, read_pieces, readable, whole_files
from ..sources.store import Store

COUNTERS = ("files_seen", "files_parsed", "files_unchanged", "lines_skipped", "lines_malformed", "events_inserted", "events_duplicate")


def scan(spark: SparkSession, store: Store, roots: list[str], source: str = "claude_code", store_raw: bool = False, rescan: bool = False, rebuild: bool = False) -> dict[str, int]:
    """One scan; returns its counters. ``rescan`` forgets the file states, ``rebuild`` the events too.

    A scan is one transaction of the store: readers see all of it or nothing, a rebuild included, and after a crash the next scan
    starts where this one did. Files that cannot be read or are not UTF-8 count as unchanged. Texts are read once."""
    with store.transaction():
        if rescan or rebuild:
            store.clear_file_state(source)
        if rebuild:
            store.delete_events(source)
        counts = _scan(spark, store, roots, source, store_raw)
    store.compact()
    return counts


def _scan(spark: SparkSession, store: Store, roots: list[str], source: str, store_raw: bool) -> dict[str, int]:
    files = list_files(spark, roots).cache()
    changed = changed_files(files, store.file_state(), source).cache()
    try:
        counts = dict.fromkeys(COUNTERS, 0) | {"files_seen": files.count()}
        paths = [r.file_path for r in changed.select("file_path").collect()]  # names of files, from which a read is planned
        if paths:
            counts |= _ingest(spark, store, changed, paths, source, store_raw)
        counts["files_unchanged"] = counts["files_seen"] - counts["files_parsed"]
        return counts
    finally:
        changed.unpersist()
        files.unpersist()


def _ingest(spark: SparkSession, store: Store, changed: DataFrame, paths: list[str], source: str, store_raw: bool) -> dict[str, int]:
    """Parse files and take in their events; what is parsed is written, so that the files are read only once."""
    folder = f"{store.folder}/staging/part={uuid.uuid4().hex}"
    parse = lambda names: parse_lines(read_pieces(spark, names), source, store_raw).write.mode("overwrite").parquet(folder)
    try:
        try:
            parse(paths)
        except Exception as error:  # noqa: BLE001
            if "AccessControlException" not in str(error):
                raise
            parse(readable(spark, paths))
        lines = spark.read.parquet(folder)
        good = whole_files(changed, lines).cache()
        n = good.count()
        if n < len(paths):
            lines = lines.join(good.select("file_path"), "file_path", "left_semi")
        kinds = lines.agg(F.count_if(F.col("kind") == "skip"), F.count_if(F.col("kind") == "malformed")).first()
        found = store.insert_events(lines.where("kind = 'event'"), ["file_path", "block", "place"])
        store.upsert_file_state(good.withColumns({"source": F.lit(source), "last_scanned_at": F.current_timestamp()}))
        good.unpersist()
    finally:
        store.discard_staging(folder)
    return {"files_parsed": n, "lines_skipped": kinds[0], "lines_malformed": kinds[1], "events_inserted": found["inserted"], "events_duplicate": found["skipped_duplicate"]}


def scan_forever(spark: SparkSession, store: Store, roots: list[str], interval_seconds: float = 60, rounds: int | None = None, log=print) -> None:
    """Scan now and then every ``interval_seconds`` (0: only once). A scan that takes longer delays the next
    one; failures are logged and tried again."""
    done = 0
    while rounds is None or done < rounds:
        try:
            scan(spark, store, roots)
            store.vacuum()
        except Exception as error:  # noqa: BLE001 - a failed round must not end the loop
            log(f"scan failed: {error}")
        done += 1
        if not interval_seconds:
            return
        if rounds is None or done < rounds:
            time.sleep(interval_seconds)


def stream_into(events: DataFrame, store: Store, checkpoint: str, available_now: bool = True):
    """Write a stream of events (schema of the events table) to the store, each event once by its key."""
    writer = events.writeStream.foreachBatch(lambda batch, _: store.insert_events(batch, ["occurred_at"])).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def bucket_totals(events: DataFrame, granularity: str = "day", watermark: str | None = None) -> DataFrame:
    """Token totals per calendar bucket and model of a stream or a table. Months have no fixed length, so
    buckets are grouped by their first day; with a watermark, days and weeks close as windows."""
    sums = [F.sum(c).alias(c) for c in TOKEN_COLUMNS]
    if watermark is None or granularity == "month":
        return events.groupBy(bucket_date(F.col("occurred_at"), granularity).alias("bucket"), "model").agg(*sums)
    window = F.window("occurred_at", "1 day") if granularity == "day" else F.window("occurred_at", "7 days", startTime="4 days")
    found = events.withWatermark("occurred_at", watermark).groupBy(window.alias("w"), "model").agg(*sums)
    return found.select(F.to_date("w.start").alias("bucket"), "model", *TOKEN_COLUMNS)
