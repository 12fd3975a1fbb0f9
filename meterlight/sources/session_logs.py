"""Session logs: JSON lines in ``root/<project>/*.jsonl``."""

from __future__ import annotations

import re
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOKEN_COLUMNS

LINE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("requestId", T.StringType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("message", T.StructType([T.StructField("model", T.StringType())])),
])
USAGE = "$.message.usage"


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """file_path, mtime_ns (in whole milliseconds), len of the logs one level below the roots.

    The driver lists the roots; what their folders hold is listed by Spark's file index, on executors if there are many, and no
    file is opened. Missing roots are skipped if there are others; without any root this is an error. Folders that cannot be
    read are skipped, and so are files whose names begin with a dot or an underscore, as by all of Spark's file sources."""
    if not roots:
        raise ValueError("no root")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(r) for r in roots]
    there = [p for p in paths if p.getFileSystem(conf).exists(p)]
    if not there and len(roots) == 1:
        raise FileNotFoundError(roots[0])
    folders, below = [], []
    for root in there:
        fs = root.getFileSystem(conf)
        below.append(fs.makeQualified(root).toString().rstrip("/"))
        folders += [f.getPath().toString() for f in _entries(fs, root) if f.isDirectory() and _can(fs, f.getPath(), "READ_EXECUTE", jvm)]
    if not folders:
        return spark.createDataFrame([], FILES)
    found = spark.read.format("binaryFile").options(pathGlobFilter="*.jsonl", recursiveFileLookup=True).load(literal(folders))
    direct = "|".join(r"\Q" + b.replace(r"\E", r"\E\\E\Q") + r"\E" for b in below)
    names = found.select(F.col("path").alias("file_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("len"))
    names = names.unionByName(_empty_files(spark, found, names))
    return names.where(F.col("file_path").rlike(f"^(?:{direct})/[^/]+/[^/]+$")).orderBy("file_path")


def _empty_files(spark: SparkSession, found: DataFrame, names: DataFrame) -> DataFrame:
    """The empty files among those of a listing, which Spark's file sources leave out when they read. Only if there are any
    are the names fetched, and only the empty files are looked at one by one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    empty = []
    if len(found._jdf.inputFiles()) != names.count():
        rows = spark.createDataFrame([(n,) for n in found.inputFiles()], "name string").select(_decoded(F.col("name")).alias("file_path"))
        for r in rows.join(names, "file_path", "left_anti").collect():
            path = jvm.org.apache.hadoop.fs.Path(r.file_path)
            status = path.getFileSystem(conf).getFileStatus(path)
            empty.append((r.file_path, status.getModificationTime() * 1_000_000, status.getLen()))
    return spark.createDataFrame(empty, FILES)


def _decoded(name: Column) -> Column:
    """The path that a URI of Spark's file sources names."""
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"^(\w+):///", "$1:/")


FILES = "file_path string, mtime_ns bigint, len bigint"


def _entries(fs, folder) -> list:
    """What a folder holds; nothing, with a warning, if it cannot be read."""
    try:
        return list(fs.listStatus(folder))
    except Py4JJavaError as error:
        warnings.warn(f"{folder.toString()} is skipped: {error.java_exception.getMessage()}", stacklevel=2)
        return []


def _can(fs, path, action: str, jvm) -> bool:
    """Whether a path allows an action; if not, with a warning."""
    try:
        fs.access(path, getattr(jvm.org.apache.hadoop.fs.permission.FsAction, action))
        return True
    except Py4JJavaError as error:
        warnings.warn(f"{path.toString()} is skipped: {error.java_exception.getMessage()}", stacklevel=2)
        return False


def readable(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the files that may be read. One call for each, so only for use when a read has been refused."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    places = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [path for path, place in zip(paths, places, strict=True) if _can(place.getFileSystem(conf), place, "READ", jvm)]


def literal(paths: list[str]) -> list[str]:
    """Paths for Spark's readers, which take them for patterns."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]


def changed_files(files: DataFrame, state: DataFrame, source: str) -> DataFrame:
    """Files whose modification time or length is not the recorded one."""
    known = state.where(F.col("source") == source).select("file_path", "mtime_ns", "len")
    return files.join(known, ["file_path", "mtime_ns", "len"], "left_anti")


def read_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of logs of any size, which tasks read in byte ranges: file_path, block (where the range begins), place
    (increases within a block), raw, n_bytes and valid (UTF-8). (file_path, block, place) has the order of the lines.

    Files that are gone, and the rest of files that break off while they are read, are left out; :func:`whole_files` tells."""
    text = spark.read.options(lineSep="\n", ignoreCorruptFiles=True, ignoreMissingFiles=True).text(literal(paths))
    return text.select(
        _decoded(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", r"\r\z", "").alias("raw"), (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"), F.is_valid_utf8("value").alias("valid"),
    )


def whole_files(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows of ``files`` (file_path, len) that are UTF-8 throughout and of which all bytes were read."""
    read = pieces.groupBy("file_path").agg(F.sum("n_bytes").alias("_bytes"), F.bool_and("valid").alias("_valid"))
    found = files.join(read, "file_path", "left").where(F.coalesce("_valid", F.lit(True)) & (F.coalesce("_bytes", F.lit(0)) >= F.col("len")))
    return found.select(*files.columns)


def with_line_numbers(pieces: DataFrame) -> DataFrame:
    """``pieces`` with line_number (from 0), counted from the number of lines in each block. Blocks are few; lines are not moved."""
    blocks = pieces.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_least"))
    before = F.sum("_n").over(Window.partitionBy("file_path").orderBy("block")) - F.col("_n")
    starts = blocks.select("file_path", "block", (before - F.col("_least")).alias("_shift"))
    return pieces.join(starts, ["file_path", "block"]).withColumn("line_number", F.col("place") + F.col("_shift")).drop("_shift")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, line_number (from 0) and raw of every line."""
    if not paths:
        return spark.createDataFrame([], "file_path string, line_number bigint, raw string")
    return with_line_numbers(read_pieces(spark, paths)).select("file_path", "line_number", "raw")


def _kind(json: Column, path: str) -> Column:
    """The type of a value in parsed JSON; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(json, path, "variant"))


def _count(raw: Column, json: Column, path: str) -> tuple[Column, Column]:
    """A count (absent: 0) and whether it is acceptable: a whole number of 64 bits, not negative."""
    place = f"{USAGE}.{path}"
    kind, text = _kind(json, place), F.get_json_object(raw, place)
    value = text.try_cast("decimal(38,0)")
    whole = (kind.startswith("BIGINT") | kind.startswith("DECIMAL")) & text.rlike(r"^[0-9]+$") & (value < F.lit(str(2**64)).cast("decimal(38,0)"))
    return F.least(F.coalesce(value, F.lit(0)), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint"), kind.isNull() | F.coalesce(whole, F.lit(False))


def parse_lines(lines: DataFrame, source: str = "claude_code", store_raw: bool = False) -> DataFrame:
    """``lines`` with ``kind`` (skip, malformed, event) and the event's columns.

    Blank lines and lines of other types are skipped; lines that are no JSON object, have no type, or are
    assistant lines without a timestamp, a message or a model, or with counts that are no whole numbers,
    are malformed. Without a split of cache writes all of them count as 5-minute ones."""
    raw, json = F.col("raw"), F.col("_json")
    parsed = lines.withColumns({"j": F.from_json(raw, LINE), "_json": F.try_parse_json(raw)})
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens"]
    counts, good = zip(*(_count(raw, json, n) for n in names), strict=True)
    usage = F.get_json_object(raw, USAGE)
    is_object = _kind(json, "$").startswith("OBJECT")
    typed = F.coalesce(_kind(json, USAGE).startswith("OBJECT"), F.lit(True))
    typed = typed & F.coalesce(_kind(json, f"{USAGE}.cache_creation").rlike("^(OBJECT|VOID)"), F.lit(True))
    for path in ("$.requestId", "$.sessionId", "$.cwd"):
        typed = typed & F.coalesce(_kind(json, path).isin("STRING", "VOID"), F.lit(True))
    for g in good:
        typed = typed & g
    at = F.try_to_timestamp(F.col("j.timestamp"))
    zoned = F.col("j.timestamp").rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$")
    named = F.coalesce(_kind(json, "$.message.model") == "STRING", F.lit(False)) & F.coalesce(_kind(json, "$.timestamp") == "STRING", F.lit(False))
    required = at.isNotNull() & F.coalesce(zoned, F.lit(False)) & named & typed
    kind = (
        F.when(F.trim(raw) == "", "skip").when(~F.coalesce(is_object & (_kind(json, "$.type") == "STRING"), F.lit(False)), "malformed")
        .when(F.col("j.type") != "assistant", "skip").when(required, "event").otherwise("malformed")
    )
    split = F.get_json_object(raw, f"{USAGE}.cache_creation").isNotNull()
    found = parsed.select(
        *lines.columns,
        kind.alias("kind"),
        F.lit(source).alias("source"),
        at.alias("occurred_at"),
        F.col("j.message.model").alias("model"),
        F.when(usage.isNull(), 0).otherwise(counts[0]).cast("bigint").alias("input_tokens"),
        counts[1].alias("output_tokens"),
        counts[2].alias("cache_read_tokens"),
        F.when(split, counts[4]).otherwise(counts[3]).alias("cache_write_5m_tokens"),
        F.when(split, counts[5]).otherwise(F.lit(0)).cast("bigint").alias("cache_write_1h_tokens"),
        F.col("j.requestId").alias("request_id"),
        F.col("j.sessionId").alias("session_id"),
        F.col("j.cwd").alias("project_id"),
        F.lit(None).cast("string").alias("workspace_id"),
        F.lit(None).cast("string").alias("api_key_id"),
    )
    hashed = F.when((F.col("kind") == "event") & F.col("request_id").isNull(), content_hash())
    kept = F.col("raw") if store_raw else F.lit(None).cast("string")
    return found.withColumn("content_hash", hashed).withColumn("raw", kept)


def content_hash() -> Column:
    """SHA-256 over time (milliseconds, UTC), model, counts, session and project."""
    return F.sha2(F.concat_ws(
        "|", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "model", *[F.col(c).cast("string") for c in TOKEN_COLUMNS],
        F.coalesce("session_id", F.lit("")), F.coalesce("project_id", F.lit("")),
    ), 256)
