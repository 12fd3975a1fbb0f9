"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group that holds 1/HEAVY of the rows or more is joined by broadcast; at most HEAVY such groups exist.
HEAVY = 1000
#: Values of 8 bytes that a shuffle partition of a statement of known size has at least (16 MiB).
CELLS = 1 << 21
#: Bytes of the batches in which :func:`small_batches` lets rows go to Python.
BATCH = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a temporary folder is set, once per session, if the master is local; on a cluster, whose
    machines would each write to a folder of their own, this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meterlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Within this block Spark removes the shuffle files of a statement as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def sized_shuffles(spark: SparkSession, cells: float | None):
    """Within this block shuffles have no more partitions than ``cells`` values of 8 bytes need, or than there are cores;
    never more than the session's own setting. None: the session's own. Loops over data that shrink run many small statements,
    each of which would otherwise start as many tasks as the largest."""
    before = shuffle_partitions(spark)
    if cells is not None:
        wanted = max(spark.sparkContext.defaultParallelism, -(-int(cells) // CELLS))
        spark.conf.set("spark.sql.shuffle.partitions", str(min(before, wanted)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python in batches of BATCH bytes, or of one row where that is larger; smaller settings stay.

    By Spark's setting a batch has 10,000 rows or 64 MB. An executor and its worker each hold several of that size for every task that
    runs, outside the heap, and what they free is not all returned to the machine.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH:  # no limit where it is not positive
        spark.conf.set(name, str(BATCH))


def materialize(df: DataFrame, name: str, cells: float | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet, by the writer's ``options``, to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and fixes values (row numbers)
    that a recomputation could change. ``cells``: the size of what is shuffled, where it is known (:func:`sized_shuffles`).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark), sized_shuffles(spark, cells):
        df.write.options(compression="zstd", **options).parquet(path)
    spark.sparkContext._jvm.System.gc()  # the same for broadcasts of plans no longer in use
    found = spark.read.schema(df.schema).parquet(path)
    found.folder = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffer_of(column) -> tuple:
    """The bytes of an Arrow column of strings or binaries (None for lists), and its rows' offsets. Nulls are empty."""
    width = np.int64 if str(column.type).startswith("large_") else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if str(column.type).removeprefix("large_").startswith("list"):
        return None, offsets
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8), offsets


def worker_cache(name: str, make):
    """A value kept for the life of a Python worker, made on first use.

    Functions of this package travel by value, so their module globals do not outlive a task.
    """
    store = sys.modules.setdefault("_meterlight_worker_cache", types.ModuleType("_meterlight_worker_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def label_rows(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``size`` its number of rows or more).

    Groups of a thousandth of the rows or more, of which there are at most HEAVY, go by broadcast;
    what is left has no hot key and is merged by key. ``total``: the sum of the sizes, where it is known. Of HEAVY rows in
    all no group is large.
    """
    total = rows.count() if total is None else total
    if total <= HEAVY:
        return rows.join(groups, key)
    least = max(2, -(-total // HEAVY))
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    light = groups.where(F.col(size) < least)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light.hint("merge"), key))


def join_spread(rows: DataFrame, others: DataFrame, key: str, salts: int = 64, of: DataFrame | None = None) -> DataFrame:
    """Inner join by a bigint ``key`` that many rows of either side may share: keys that a thousandth of ``rows`` or
    more have are dealt over ``salts`` parts, in each of which the other side's rows of these keys occur. ``of``: a table
    with the same keys as ``rows`` that is cheaper to read twice."""
    of = rows if of is None else of
    total = of.count()
    if total <= HEAVY:
        return rows.join(others, key)
    least = max(2, -(-total // HEAVY))
    heavy = F.broadcast(of.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key))
    rest = rows.join(heavy, key, "left_anti").join(others, key)
    dealt = rows.join(heavy, key, "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = others.join(heavy, key, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return rest.unionByName(dealt.join(copies, [key, "_salt"]).drop("_salt"))


def keyed(docs: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with its key and id beside it: no column of the input can
    clash with these. ``id`` is 0 where it is null, and ``no_id`` says so, so that plain equality joins them."""
    number = F.col(id_col).cast("bigint")
    return docs.select(F.struct("*").alias("row"), key.alias("key"), F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"))


def named(ids: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """The key, id and no_id of :func:`keyed`, of rows that are named by id and key."""
    number = F.col(id_col).cast("bigint")
    return ids.select(F.col(key_col).alias("key"), F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (id, text_key), one row for each, with all their columns.

    ``text_key`` is :func:`text_key` of the text, so ids that occur with several texts stay apart. Joined on
    both, so copies of one text do not meet in one task; the choice of one row needs no further shuffle.
    """
    place = ["key", "id", "no_id"]
    joined = keyed(docs, id_col, text_key(F.col(text_col))).join(named(kept, "id", "text_key"), place)
    one = Window.partitionBy(*place).orderBy(F.lit(1))
    return joined.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def text_key(text):
    """A 64-bit hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
