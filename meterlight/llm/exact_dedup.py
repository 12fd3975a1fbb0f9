"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table with one row per distinct text ever accepted. A batch is reduced to
one row per digest (map-side combine, so a text that makes up a third of the batch costs one row
per task), sort-merge anti-joined with the index, whose buckets are neither shuffled nor moved,
and what is new is appended.

Defined cases: a null text counts as empty. Of equal texts in a batch the row with the largest id
stays (a null id is the smallest; of rows that also share the id, one stays). A text that an
earlier batch brought in keeps that batch's row; the same batch tried again keeps its rows. Empty batches leave the index as it is. Other
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, label_rows, materialize, named, shared_folder, shuffle_partitions, table


def digest(text: F.Column) -> F.Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """A digest table in the shared folder; ``buckets`` fixes its layout for its whole life."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            f" LOCATION '{shared_folder(spark)}/{self.name}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate one batch and append what is new. A batch that may be tried again, as its job can die after
        the append, needs a name of its own, ``batch``: what the index holds under it counts as new.

        Returns one row per input row: id, digest, keep_id (the row that stays), group_size (rows of
        this batch with that text), kept.
        """
        batch = batch or uuid.uuid4().hex
        rows = materialize(
            docs.select(
                F.col(id_col).cast("bigint").alias("id"),
                F.monotonically_increasing_id().alias("row"),
                digest(F.col(text_col)).alias("digest"),
            ),
            "digests",
        )
        groups = (
            rows.groupBy("digest")
            .agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"), "group_size")
        )
        fresh = groups.join(self.read().hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .format("parquet").saveAsTable(self.name)
        )
        found = groups.select("digest", "group_size", "best_row").join(self.read().hint("merge"), "digest")
        # Rows are numbered anew by each trial, so the number in the index may be that of an earlier one.
        found = found.select(
            "digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("best_row")).alias("keep_row")
        )
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
        return label_rows(rows, found, "digest", "group_size").select("id", "digest", "keep_id", "group_size", kept)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns.

    Joined on digest and id together, so copies of one text do not meet in one task.
    """
    index = DigestIndex(docs.sparkSession)
    index.add(docs, id_col, text_col)
    place = ["key", "id", "no_id"]
    joined = keyed(docs, id_col, digest(F.col(text_col))).join(named(index.read(), "keep_id", "digest"), place)
    one = Window.partitionBy(*place).orderBy(F.lit(1))
    return joined.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return DigestIndex(spark).add(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce("text", '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce("text", '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce("text", '')) AS kept,
       sha256(coalesce("text", '')) AS text_sha256
FROM documents
"""
