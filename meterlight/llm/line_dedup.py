"""Line dedup by site-relative frequency.

Pages are grouped by host; the number of the host's pages that contain a line, over the number of its
pages, is the line's frequency there. Lines above a boilerplate ratio are dropped from the host's
pages. Everything is DataFrame functions; lines are counted by the MD5 of their text, once per page, with
partial counts before the shuffle. A line that a third of all pages share is joined by broadcast (at
most a thousand lines can be on a thousandth of all page lines), all others by key.

Lines of an HTML page are what lies between block-level tags and line breaks, without comments,
scripts, styles and inline tags, white space made single and trimmed; empty lines do not count. For
plain text pass ``html=False``.

Defined cases: a null page has no lines; a null or hostless url belongs to the host ``""``; a line on
fewer than ``min_pages`` pages of its host is never boilerplate, whatever its share; each occurrence of a
boilerplate line in a page is dropped. Rows may repeat: each is a page of its own. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import label_rows, materialize, table

#: Share of a host's pages above which a line is boilerplate, and the least number of pages it must be on.
RATIO, MIN_PAGES = 0.3, 3
#: Hosts whose numbers of pages are broadcast; beyond, only those of large hosts are.
HOSTS = 100_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
INVISIBLE = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<head\b.*?</head>")
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol"
    r"|p|pre|section|table|td|th|tr|ul)(?:[\s/][^>]*)?>"
)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(text: Column, html: bool = True) -> Column:
    """The lines of a page that are not empty, as an array."""
    text = F.coalesce(text, F.lit(""))
    if html:
        for pattern in INVISIBLE:
            text = F.regexp_replace(text, pattern, "")
        text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" *\n[ \n]*", "\n")
    return F.filter(F.split(F.trim(text), "\n"), lambda line: line != F.lit(""))


def drop_boilerplate(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, html: bool = True,
) -> DataFrame:
    """Per page: id, host, n_lines, n_dropped and text (the lines that stay, joined by line breaks)."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        host_of(F.col(url_col)).alias("host"),
        lines_of(F.col(text_col), html).alias("lines"),
    )
    rows = materialize(rows.withColumn("keys", F.transform("lines", lambda line: F.unhex(F.md5(line)))), "lines")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    once = rows.select("row", "host", F.explode(F.array_distinct("keys")).alias("key"))
    counts = once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    if totals.count() <= HOSTS:
        common = counts.join(F.broadcast(totals), "host")
    else:  # a large host's lines must not meet in one task
        counts = materialize(counts, "counts")
        sizes = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_lines"))
        common = label_rows(counts, materialize(totals.join(sizes, "host"), "hosts"), "host", "n_lines")
    common = common.where((F.col("n_pages") >= min_pages) & (F.col("n_pages") > ratio * F.col("n_host")))
    common = materialize(common.select(F.struct("host", "key").alias("line"), "n_pages"), "boilerplate")
    hits = label_rows(once.select("row", F.struct("host", "key").alias("line")), common, "line", "n_pages")
    dropped = hits.groupBy("row").agg(F.collect_set("line.key").alias("gone"))  # at most the lines of one page
    stay = F.filter(F.arrays_zip("lines", "keys"), lambda x: ~F.array_contains("gone", x["keys"]))
    joined = rows.join(dropped, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<binary>")))
    return joined.withColumn("stay", stay).select(
        "id", "host",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("stay", lambda x: x["lines"]), "\n").alias("text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` without its host's boilerplate lines."""
    return drop_boilerplate(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "host", "n_lines", "n_dropped", "text", F.sha2("text", 256).alias("text_sha256")
    )


def _oracle() -> str:
    text = "coalesce(html, '')"
    for pattern in INVISIBLE:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    text = f"regexp_replace({text}, '{BREAKS}', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
         list_filter(string_split(trim({text}, ' '), chr(10)), lambda x: x <> '') AS lines,
         row_number() OVER () AS r
  FROM pages
), t AS (SELECT host, count(*) AS n_host FROM p GROUP BY host),
c AS (
  SELECT host, line, count(*) AS n_pages
  FROM (SELECT DISTINCT r, host, line FROM (SELECT r, host, unnest(lines) AS line FROM p)) GROUP BY host, line
), b AS (
  SELECT host, list(line) AS gone FROM c JOIN t USING (host)
  WHERE n_pages >= {MIN_PAGES} AND n_pages > {RATIO}e0 * n_host GROUP BY host
), k AS (
  SELECT p.page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay
  FROM p LEFT JOIN b ON p.host = b.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS "text", sha256(coalesce(array_to_string(stay, chr(10)), '')) AS text_sha256
FROM k
"""


ORACLE_SQL = _oracle()
