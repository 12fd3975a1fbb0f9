"""Periodic runs in texts, by Main and Lorentz's divide and conquer.

The words of a text become numbers. A stretch is halved, Z-functions at its midpoint give for every period the longest
repetition across that midpoint, and the halves are treated alike. What a word before or behind would extend is part of a
longer run that a larger stretch has found; of the periods found for one interval the smallest counts.

A run of length L and period q has L - q >= LEAST / 2 words that equal the words q places on, so all its words lie in
word sequences of LEAST / 2 that occur twice in the text. Only stretches of such words are halved; everything else cannot
be part of a run. That is a filter without loss: sequences are told apart by hashes, so it lets through too much at worst.

Defined cases: a null text has no words and no runs; a text without words gives an empty collapsed text. Words are maximal
sequences of bytes other than white space (space, tab to carriage return). Rows are treated one by one, so ids may repeat
or be null, and texts may be of any length: they are read in pieces, and only the numbers of their words and the words
that occur are held. Columns other than id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hashing import rolling

#: The least length of a run, and the least number of its periods.
LEAST, REPEATS = 12, 2
#: Bytes of a text that are split into words at a time, words that are joined at a time.
PIECE, JOINED = 1 << 22, 1 << 16
#: Words that are kept with their numbers from one text to the next.
NAMES = 1 << 20
WHITE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Names(dict):
    """Numbers of words, in the order of their first occurrence; ``order`` has the words by number."""

    def __init__(self):
        super().__init__()
        self.order: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.order.append(word)
        return found


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end at white space."""
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + PIECE) if len(data) > start + PIECE else None
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def numbered(data: bytes, names: _Names) -> np.ndarray:
    """The words of a text as numbers."""
    parts = [np.fromiter(map(names.__getitem__, words), np.int64, len(words)) for words in _words(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def z_function(symbols: list) -> list[int]:
    """For each place the length of the longest common prefix of what begins there and the whole."""
    n = len(symbols)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and symbols[k] == symbols[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(words: list, low: int, middle: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the repetitions within [low, high) that have a whole period on one side of ``middle``
    and are extended to both sides as far as the stretch goes."""
    left, right = words[low:middle], words[middle:high]
    n, m = len(left), len(right)
    back = left[::-1]
    ahead = z_function([*right, -1, *left, *right])  # common prefixes with what begins at the middle
    behind = z_function([*back, -1, *right[::-1], *back])  # common suffixes with what ends at the middle
    ahead, behind = np.array([*ahead, 0]), np.array([*behind, 0])
    q = np.arange(1, n + 1)  # periods that lie left of the middle
    before = np.append(behind[1:n], 0)
    after = ahead[m + 1 + n - q]
    good = before + after >= q
    found = [(middle - q - before)[good], (middle + after)[good], q[good]]
    q = np.arange(1, m + 1)  # and right of it
    before = behind[n + 1 + m - q]
    after = np.append(ahead[1:m], 0)
    good = before + after >= q
    return tuple(np.concatenate(x) for x in zip(found, [(middle - before)[good], (middle + q + after)[good], q[good]], strict=True))


def runs_of_stretch(stretch: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of one stretch, by start and period."""
    words = stretch.tolist()
    total, best = len(words), {}
    open_ = [(0, total)]
    while open_:
        low, high = open_.pop()
        if high - low < least:
            continue
        middle = (low + high) // 2
        open_ += [(low, middle), (middle, high)]
        starts, ends, periods = _crossing(words, low, middle, high)
        length = ends - starts
        good = (length >= least) & (length >= REPEATS * periods)
        for start, end, q in zip(starts[good].tolist(), ends[good].tolist(), periods[good].tolist(), strict=True):
            if start and words[start - 1] == words[start - 1 + q] or end < total and words[end] == words[end - q]:
                continue
            if q < best.get((start, end), total):
                best[start, end] = q
    return sorted((start, end - start, q) for (start, end), q in best.items())


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of a text, by start and period."""
    n, size = len(words), max(least // REPEATS, 1)
    if n < least:
        return []
    hashes = rolling(words, size)
    ordered = np.sort(hashes)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return []
    places = np.flatnonzero(np.isin(hashes, ordered[1:][twice]))
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + size, -1)
    inside = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    found = []
    for start, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        if end - start >= least:
            found += [(start + s, length, q) for s, length, q in runs_of_stretch(words[start:end], least)]
    return found


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def _joined(vocabulary: list[bytes], numbers: np.ndarray) -> bytes:
    parts = [b" ".join([vocabulary[i] for i in numbers[k : k + JOINED].tolist()]) for k in range(0, len(numbers), JOINED)]
    return b" ".join(parts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period) and collapsed (the text without the words that
    repeat a run's first period, joined by one space) of every row."""

    def compute(batches):
        names = _Names()
        for batch in batches:
            counts, listed, texts = [], [], []
            for data in batch.column("text"):
                if len(names) > NAMES:
                    names = _Names()
                words = numbered(data.as_py() or b"", names)
                found = runs(words, least)
                counts.append(len(words))
                listed.append(found)
                texts.append(_joined(names.order, words[kept_words(len(words), found)] if found else words))
            ends = np.cumsum([0, *map(len, listed)]).astype(np.int32)
            flat = np.array([r for found in listed for r in found], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    schema = "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(compute, schema)


def longest(found: Column) -> Column:
    """The run of greatest length, then least start, then least period; null without any."""
    ranked = F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; of a tenth of them, told by the CRC of the id, the end repeats a period."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WHITE), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("_h div 10"), F.size("_words").cast("bigint")
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when((F.col("_h") % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), words))
    placed = chosen.withColumn("_a", F.when(n > 0, F.pmod(g, n))).withColumn("_p", F.floor((n - F.col("_a")) / (3 + g % 8)) + 1)
    turned = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("_words").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every row of ``documents``, after the contract's change of a tenth of the texts. A null doc_id has no CRC,
    so its text is taken as it is."""
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    best = longest(F.col("runs"))
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("_best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
