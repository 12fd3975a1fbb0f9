"""Ranked lexical search with a tiered index.

Index. Each task turns its documents into segments of at most SEGMENT postings (a longer document is a segment of its own).
A posting's impact is its part of a score before the term's weight. A term's postings lie in tiers: first those of highest
impact, then the next, then the rest, each with the residual bound, the highest impact that lower tiers still hold. A
segment is one row whose tiers are columns, so a search reads the tiers it asks for and no others. Nothing is shuffled.

Search, for blocks of items with a bounded number of terms. The first pass reads only the first tiers and gives each item the
k-th highest of its partial scores over all segments, a threshold that no result lies below. The second pass adds up tier
by tier: once the partial score of a document and the residual bounds of the terms it has not been seen with stay below the
threshold, the document is out; if this holds for all documents of a segment, the item needs nothing more of it. What lacks that proof falls
through to the next tier, where few remaining documents are looked up and many are added up; after the last tier scores are
exact. Tasks give their k best of an item, and these are ranked.

Defined cases: a null text has no terms, and such a document is neither counted nor found. Terms are told apart by their bytes.
Rows are told apart, so repeated ids or texts are ranked as rows of their own, equal ones in any order; null ids come last among
equal scores. Each row of items gets a ranking of its own, even if ids repeat or are null; one without known terms gets none.
Texts may be of any length. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Results of an item.
BEST = 50
#: Postings of a segment; postings of a term that its first tiers hold in a segment (the last tier has the rest).
SEGMENT, TIERS = 1 << 20, (32, 512)
#: Pairs of item and term that are searched for at a time.
BLOCK = 500_000
#: A tier is probed where it is so many times longer than the list of documents in question.
PROBE = 16
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Bytes of terms (A to Z in lower case); all others separate.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces that end between terms."""
    data, start = text.translate(_BYTES), 0
    while start < len(data):
        space = data.find(b" ", start + PIECE) if len(data) > start + PIECE else -1
        end = space if space >= 0 else len(data)
        # only spaces separate: other white space has become one, and bytes from 0x80 on are no white space
        yield data[start:end].split()
        start = end


def _utf8(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


def collection_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and the number of all their terms."""

    def compute(batches):
        for batch in batches:
            sizes = [sum(map(len, terms(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(s > 0 for s in sizes)], pa.int64()), "l": pa.array([sum(sizes)], pa.int64())})

    found = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).mapInArrow(compute, "n bigint, l bigint")
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first())


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = found = len(self)
        return found


class _Segment:
    """Postings of some documents, in the making."""

    def __init__(self):
        self.numbers = _Numbers()
        self.terms, self.counts, self.sizes = [], [], []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.total = 0

    def add(self, id: int | None, counts: Counter) -> None:
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.ids.append(id)
        self.lengths.append(sum(counts.values()))
        self.total += len(counts)

    def columns(self, n: int, length: int) -> dict:
        """The finished segment. ``n`` documents have ``length`` terms in all."""
        number, count = np.concatenate(self.terms), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms])
        norm = np.array([50 + 50 * size * n // length for size in self.lengths], np.int64)
        impact = 1_000_000_000 * count // (1000 * count + 20 * norm[doc])  # below 2 ** 20
        df = np.bincount(number, minlength=len(self.numbers))
        order = np.argsort((number.astype(np.int64) << 20) + ((1 << 20) - 1 - impact), kind="stable")
        number, impact, doc = number[order], impact[order], doc[order]
        starts = np.cumsum(df) - df
        place = np.arange(len(number)) - starts[number]
        row = {
            "terms": b" ".join(self.numbers), "df": df.astype("<i4").tobytes(), "ids": np.array([i or 0 for i in self.ids], "<i8").tobytes(),
            "no_id": np.array([i is None for i in self.ids], bool).tobytes(),
        }
        low = 0
        for t, high in enumerate((*TIERS, None)):
            inside = place >= low if high is None else (place >= low) & (place < high)
            by_doc = np.argsort((number[inside].astype(np.int64) << 32) + doc[inside])
            row[f"size{t}"] = np.bincount(number[inside], minlength=len(df)).astype("<i4").tobytes()
            row[f"docs{t}"] = doc[inside][by_doc].astype("<i4").tobytes()
            row[f"impacts{t}"] = impact[inside][by_doc].astype("<i4").tobytes()
            rest = np.zeros(len(df), "<i4")
            if high is not None:
                more = df > high
                rest[more] = impact[starts[more] + high]
                low = high
            row[f"rest{t}"] = rest.tobytes()
        return row


_SHARED = ["terms", "ids", "no_id"]
_TIER = ["size", "docs", "impacts", "rest"]
COLUMNS = [*_SHARED, "df", *[f"{c}{t}" for t in range(len(TIERS) + 1) for c in _TIER]]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> tuple[DataFrame, int, int]:
    """The written index, one row per segment, and :func:`collection_size`."""
    n, length = collection_size(docs, text_col)
    schema = pa.schema([(c, pa.binary()) for c in COLUMNS])

    def compute(batches):
        open_ = _Segment()
        for batch in batches:
            for id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                counts = Counter()
                for piece in terms(text.as_py()):
                    counts.update(piece)
                if not counts:
                    continue
                open_.add(id.as_py(), counts)
                if open_.total >= segment:
                    yield pa.RecordBatch.from_pylist([open_.columns(n, length)], schema)
                    open_ = _Segment()
        if open_.total:
            yield pa.RecordBatch.from_pylist([open_.columns(n, length)], schema)

    found = _utf8(docs, id_col, text_col).mapInArrow(compute, ", ".join(f"{c} binary" for c in COLUMNS))
    return materialize(found, "lexical_index", **{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}), n, length


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number of the row), id and term: the distinct terms of every item."""

    def compute(batches):
        for batch in batches:
            found = [{x for piece in terms(t.as_py()) for x in piece} for t in batch.column("text")]
            sizes = [len(f) for f in found]
            columns = [pa.array(np.repeat(np.arange(len(found)), sizes)), pa.array([x for f in found for x in f], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(columns[0]) for c in ("item", "id")] + columns[1:], names=["item", "id", "term"])

    rows = materialize(_utf8(items, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "items")
    return rows.mapInArrow(compute, "item bigint, id bigint, term binary")


class _Block:
    """Items that are searched for together: their terms and, when known, weights and thresholds."""

    def __init__(self, rows: list):
        self.numbers = _Numbers()
        self.ids: dict[int, int | None] = {}
        self.of: dict[int, list[int]] = {}
        for r in rows:
            self.ids[r.item] = r.id
            self.of.setdefault(r.item, []).append(self.numbers[bytes(r.term)])
        self.weights: list[int] = []
        self.least: dict[int, int] = {}


class _Reader:
    """The postings of one segment that belong to a block's terms, with weighted impacts."""

    def __init__(self, row: dict, block: _Block, tiers: int):
        self.ids, self.no_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], bool)
        here = {block.numbers[t]: k for k, t in enumerate(row["terms"].split(b" ")) if t in block.numbers}
        self.weights, self.lists, self.rests = block.weights, [], []
        for t in range(tiers):
            ends = np.cumsum(np.frombuffer(row[f"size{t}"], "<i4").astype(np.int64))
            docs, impacts, rest = (np.frombuffer(row[f"{c}{t}"], "<i4") for c in ("docs", "impacts", "rest"))
            lists = {}
            for number, k in here.items():
                if block.weights[number]:
                    a, b = (int(ends[k - 1]) if k else 0), int(ends[k])
                    if a < b:
                        lists[number] = docs[a:b], impacts[a:b].astype(np.int64) * block.weights[number]
            self.lists.append(lists)
            self.rests.append({number: int(rest[k]) * block.weights[number] for number, k in here.items()})

    def partial(self, numbers: list[int]) -> np.ndarray:
        """Scores by the first tier."""
        scores = np.zeros(len(self.ids), np.int64)
        for number in numbers:
            if (found := self.lists[0].get(number)) is not None:
                scores[found[0]] += found[1]
        return scores

    def bound(self, numbers: list[int], tier: int) -> int:
        """The most that tiers below ``tier`` can add to a score."""
        return sum(self.rests[tier].get(number, 0) for number in numbers)

    def search(self, numbers: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of ``least`` or more, and their exact scores.

        What a document may still get is the residual bounds of the terms that it has not been seen with."""
        scores = np.zeros(len(self.ids), np.int64)
        left = np.full(len(self.ids), self.bound(numbers, 0))
        open_ = np.arange(len(self.ids))
        for tier, lists in enumerate(self.lists):
            rests = self.rests[max(tier - 1, 0)]
            for number in numbers:
                if (found := lists.get(number)) is None:
                    continue
                docs, parts = found
                if len(open_) * PROBE < len(docs):
                    at = np.minimum(np.searchsorted(docs, open_), len(docs) - 1)
                    hit = docs[at] == open_
                    docs, parts = open_[hit], parts[at[hit]]
                scores[docs] += parts
                left[docs] -= rests[number]
            left = np.minimum(left, self.bound(numbers, tier))
            open_ = open_[scores[open_] + left[open_] >= least]
            if not left[open_].any():
                break
        return open_, scores[open_]


def _best(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, no_id, -scores))[:k]


def _thresholds(index: DataFrame, block, k: int) -> dict[int, int]:
    """The k-th highest partial score of each item by the first tiers."""

    def compute(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Reader(row, block.value, 1)
                for item, numbers in block.value.of.items():
                    scores = reader.partial(numbers)
                    scores = np.concatenate([best.get(item, scores[:0]), scores[scores > 0]])
                    best[item] = np.sort(np.partition(scores, len(scores) - k)[len(scores) - k :] if len(scores) > k else scores)
        for item, scores in best.items():
            yield pa.RecordBatch.from_pydict({"item": np.full(len(scores), item), "score": scores})

    rows = index.select(*_SHARED, *[f"{c}0" for c in _TIER]).mapInArrow(compute, "item bigint, score bigint")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    return {r.item: r.score for r in ranked.where(F.col("rank") == k).collect()}  # a row per item of the block


def _weights(index: DataFrame, block: _Block, n: int) -> list[int]:
    """The weights of a block's terms."""
    shared = index.sparkSession.sparkContext.broadcast(dict(block.numbers))

    def compute(batches):
        for batch in batches:
            for row in batch.to_pylist():
                df = np.frombuffer(row["df"], "<i4")
                found = [(shared.value[t], int(df[k])) for k, t in enumerate(row["terms"].split(b" ")) if t in shared.value]
                yield pa.RecordBatch.from_pydict({"number": pa.array([f[0] for f in found], pa.int64()), "df": pa.array([f[1] for f in found], pa.int64())})

    rows = index.select("terms", "df").mapInArrow(compute, "number bigint, df bigint").groupBy("number").agg(F.sum("df").alias("df"))
    weights = [0] * len(block.numbers)
    for r in rows.collect():  # a row per term of the block
        weights[r.number] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
    return weights


def _search_block(index: DataFrame, block: _Block, n: int, k: int) -> DataFrame:
    """item, item_id, rank, doc_id and score of a block's items."""
    context = index.sparkSession.sparkContext
    block.weights = _weights(index, block, n)
    block.least = _thresholds(index, context.broadcast(block), k)
    shared = context.broadcast(block)

    def compute(batches):
        asked, best = shared.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Reader(row, asked, len(TIERS) + 1)
                for item, numbers in asked.of.items():
                    kept = best.get(item)
                    least = max(asked.least.get(item, 1), 1, int(kept[0][-1]) if kept and len(kept[0]) == k else 1)
                    docs, scores = reader.search(numbers, least)
                    if len(docs):
                        found = scores, reader.ids[docs], reader.no_id[docs]
                        found = found if kept is None else tuple(np.concatenate(x) for x in zip(kept, found, strict=True))
                        order = _best(*found, k)
                        best[item] = tuple(x[order] for x in found)
        for item, (scores, ids, no_id) in best.items():
            size = len(scores)
            yield pa.RecordBatch.from_pydict({
                "item": np.full(size, item), "item_id": pa.array([asked.ids[item]] * size, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=no_id), "score": scores,
            })

    rows = index.drop("df").mapInArrow(compute, "item bigint, item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", segment: int = SEGMENT, block: int = BLOCK
) -> DataFrame:
    """item (a number of the item's row), item_id, rank, doc_id and score: each item's ``k`` documents of highest score above 0."""
    spark = docs.sparkSession
    asked = materialize(_item_terms(items, item_col, item_text), "item_terms")
    n_blocks = max(1, -(-asked.count() // block))
    index, n, _ = build_index(docs, id_col, text_col, segment)
    found = []
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        if rows:
            found.append(materialize(_search_block(index, _Block(rows), n, k), "ranked"))
    discard(index, asked)
    columns = ["item", "item_id", "rank", "doc_id", "score"]
    if not found:
        return spark.createDataFrame([], "item bigint, item_id bigint, rank int, doc_id bigint, score bigint")
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result.select(*columns)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of ``documents`` for every item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS t FROM documents),
size AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, size GROUP BY term, n_docs),
q AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_SPLIT} AS t FROM benchmark)),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), size GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
