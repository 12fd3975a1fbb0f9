"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Language ID (documents that it rejects go), exact dedup, near-dedup by five-word shingles (one document of
each group stays), benchmark decontamination, byte-level BPE encoding and decoding. All but the last stage return the
columns of ``documents``.

Every stage sends rows to Python in small batches (:func:`small_batches`), and no task of a stage has two Python workers at once, so
that what executors need besides their heap does not follow the size of the texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm import bpe, decontaminate, exact_dedup, language_id, near_dup
from meterlight.llm.common import materialize, small_batches, table


def in_small_batches(stage):
    """``stage`` in a session of small batches, which stays so, as the rows that it returns are computed later."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those unlike all languages of the corpus."""
    prefix = "_" * (1 + max(map(len, docs.columns)))  # clashes with no column
    found = language_id.predict(docs, language_id.fit(docs), prefix=prefix)
    return found.where(~F.col(prefix + "rejected")).select(*docs.columns)


@in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.distinct_documents(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the least id stays."""
    return near_dup.drop_near_duplicates(docs)


@in_small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its numbers and names exchanged or not."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids of every text, their number, and whether they decode to the text's bytes."""
    ids, decoded = "ids", "_" * (1 + max(map(len, docs.columns))) + "decoded"  # clashes with no column
    found = bpe.encode(docs, out=ids, decoded=decoded)
    same = F.col(decoded) == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.withColumn("n_tokens", F.size(ids).cast("bigint")).withColumn("round_trip", same).drop(decoded)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]

#: SQL can express neither the language models nor the fingerprints; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
