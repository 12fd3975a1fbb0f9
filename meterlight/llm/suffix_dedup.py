"""Removal of repeated byte strings by a distributed difference-cover suffix algorithm.

Every byte of a text that lies in a string of LENGTH bytes which also starts anywhere else (in another
text or the same) is removed. Suffixes are told apart by their first LENGTH bytes only, so the recursion
of the difference-cover construction ends after two levels:

1. Sampled suffixes start at the positions whose remainder modulo 133 is in a difference cover of twelve
   residues: for any two positions there is a shift below 133 that takes both to sampled ones. The
   triple of 89-byte blocks at a sampled suffix gets a name (equal triples, equal names).
2. Recursion on names: the triple of names at the sampled positions 133 before, at, and 133 after, all of
   one residue class, is named again. It stands for the 533 bytes around the position, and so for all 134
   windows of LENGTH bytes in which the sampled suffix lies 133 bytes from the start or less.
3. Sorting by name brings equal suffixes together. A name of the second level that occurs twice settles
   all its windows: they are repeated. A name of the first level that has one second-level name only is
   discarded: no window around it has a counterpart elsewhere that is not settled.
4. The remaining suffixes are the windows around the other sampled ones: of each second-level name one
   occurrence is enough. They are named by their LENGTH bytes and sorted; equal neighbours are repeated.

That finds every pair: two equal windows have a shift below 133 to sampled suffixes with equal first-level
names, and either these have equal second-level names, or both windows, or windows equal to them, remain.

Before sampling, stretches without any repeated string are ruled out by winnowing: of the 32-grams in a
window of LENGTH bytes the least hash is a function of the window's content alone, so a window can be
repeated only if that 32-gram occurs as such a least one elsewhere too.

Beside the bytes, the words are counted that lie in a string of PASSAGE words which another row holds
too. That is found in the same pass by the same winnowing, over words; the words around each shared 8-gram
are named (the second level), which settles most of them, and the remaining windows are named one by one.

What decides a removal has a name of 128 bits: a polynomial hash and a nonlinear one, independent of each
other. They stand for ranks, as only equality counts and a global order would need a sort of all names; 1e13
names collide with a probability of 2e-13. First-level names and grams only select candidates and have 64
bits. Texts are told apart by SHA-256: their key is a 64-bit hash whose last four bits number the texts
that share the rest.

Equal texts are worked on once. Texts are written once, bucketed by their key, so that the later steps join
them without a shuffle; everything else that is shuffled is names and positions: the sampled suffixes once
and the remaining windows once, sorted by name. Before, every task combines chunks of CHUNK of them, so that a
name which very many texts share meets with a few rows of each chunk only: repetitions within a chunk are
settled there, and of a name with several second-level names in a chunk the suffixes remain in any case and are
spread by the latter. Grams that hold a thousandth of all are joined by broadcast.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows count as
occurrences elsewhere; ids may repeat or be null; other columns are not read; an empty table gives no
rows. Texts of any size are read in pieces.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffer_of, discard, freed_shuffles, label_rows, materialize, shared_folder, shuffle_partitions, table
from .hashing import SpanHasher, long_words, mix, rolling, runs, words_of

LENGTH = 400
#: A perfect difference set: each remainder but 0 is the difference of exactly one pair.
PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BLOCK = (LENGTH - PERIOD + 1) // 3
#: Length of the n-grams of bytes that winnowing compares.
GRAM = 32
#: Words of a passage, and of the n-grams within it.
PASSAGE, WORD_GRAM = 51, 8
#: Bytes of texts that are winnowed at once.
PIECE = 1 << 18
#: Suffixes or windows that a task combines before they are shuffled.
CHUNK = 1 << 20
#: The bits of a text's hash that its key takes over; the four below them tell texts apart that share these.
KEY_MASK = ~15

BASE2 = 0xD1342543DE82EF95


def _bytes(data) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def pieces(offsets: np.ndarray, limit: int, length: int):
    """first row, end row, first byte and end byte of runs of whole texts with at most ``limit`` bytes, and of the
    parts of a longer text, which overlap so that each window of ``length`` bytes lies in one of them."""
    for row, end in runs(offsets, limit):
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= limit:
            yield row, end, a, b
        else:
            for start in range(a, max(b - length + 1, a + 1), limit):
                yield row, end, start, min(start + limit + length - 1, b)


def winnow(hashes: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the least of each ``width`` consecutive hashes for the windows in the intervals (ascending,
    not adjacent), each with its first and last window."""
    some = first <= last
    first, last = first[some], last[some]
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    n = int(last[-1]) + 1
    low = np.uint64((1 << max(1, len(hashes).bit_length())) - 1)
    padded = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_and(hashes, ~low, out=padded[: len(hashes)])
    padded[: len(hashes)] |= np.arange(len(hashes), dtype=np.uint64)
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    change = np.zeros(n + 1, np.int8)
    change[first] += 1
    change[last + 1] -= 1
    valid = np.cumsum(change, dtype=np.int8).astype(bool)
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | ~valid[: n - 1]
    starts = np.flatnonzero(new[:n] & valid[:n])
    ends = np.flatnonzero(valid[:n] & (new[1:] | ~valid[1:]))
    return least[starts], starts, ends


def union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge closed intervals that meet or overlap."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1] + 1])
    return first[new], np.append(last[:-1][new[1:]], last[-1])


def intersection(first: np.ndarray, last: np.ndarray, first2: np.ndarray, last2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What two sets of disjoint closed intervals have in common."""
    start, end = np.searchsorted(last2, first, "left"), np.searchsorted(first2, last, "right")
    own = np.repeat(np.arange(len(first)), end - start)
    other = spread(start, end - 1)
    return np.maximum(first[own], first2[other]), np.minimum(last[own], last2[other])


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers in disjoint closed intervals."""
    sizes = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(first) else first


def byte_anchors(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the least 32-grams of the windows of LENGTH bytes within texts (``first`` and ``end`` of
    each), with their first and last windows."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = rolling(data, GRAM)
    least, starts, ends = winnow(hashes, LENGTH - GRAM + 1, first, end - LENGTH)
    return mix(hashes[least]), starts, ends


class Passages:
    """Words of texts, and names of what lies around their grams."""

    def __init__(self):
        self.words, self.other = SpanHasher(), SpanHasher(BASE2)
        self.margin = PASSAGE - WORD_GRAM

    def anchors(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes of the least grams of words of the passages within texts, 128-bit names of the words around
        each (as far as passages reach, and where the text begins or ends), text, first and last passage."""
        if len(first) == 1:
            words = long_words(data, self.words, PIECE)
            count = np.array([len(words)])
        else:
            words, count = words_of(data, first, end, self.words)
        gap = self.margin  # between texts, so that nothing reaches into another one
        begin = np.concatenate([[0], np.cumsum(count)[:-1]]) + gap * (np.arange(len(count)) + 1)
        placed = np.zeros(int(count.sum()) + gap * (len(count) + 1), np.uint64)
        placed[np.arange(len(words)) + gap * (np.repeat(np.arange(len(count)), count) + 1)] = words
        if len(placed) < PASSAGE:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64), none, none, none
        hashes = rolling(placed, WORD_GRAM)
        least, starts, ends = winnow(hashes, PASSAGE - WORD_GRAM + 1, begin, begin + count - PASSAGE)
        text = np.searchsorted(begin, starts, "right") - 1
        around = least - self.margin, least + WORD_GRAM + self.margin
        names = self.words(placed, *around), self.other(placed, *around)
        return mix(hashes[least]), *names, text, starts - begin[text], ends - begin[text]

    def windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the passages at places of one text, as two halves."""
        words = long_words(data, self.words, PIECE)
        return self.words(words, at, at + PASSAGE), self.other(words, at, at + PASSAGE)


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(mix(a) + b) * np.uint64(3) + c)


class Sampler:
    """Names of the sampled suffixes of a text."""

    def __init__(self, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER):
        self.length, self.period = length, period
        self.block = (length - period + 1) // 3
        self.member = np.zeros(period, bool)
        self.member[list(cover)] = True
        self.step = len(cover)
        self.hasher = SpanHasher()

    def __call__(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Positions, first-level names and the halves of the second-level names of the sampled suffixes within
        reach of the windows in the intervals."""
        n, reach, pad = len(symbols), 3 * self.block, self.period
        first, last = union(first, np.minimum(last + self.period - 1, n - reach))
        found = [np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * 3
        parts = [[f] for f in found]
        for low, high in zip(first.tolist(), last.tolist(), strict=True):
            for start in range(low, high + 1, PIECE):
                stop = min(start + PIECE, high + 1)
                at = np.arange(start - pad, stop + pad)  # the neighbours of the second level, too
                at = at[self.member[at % self.period]]
                a, b = start - pad, stop + pad + reach
                near = np.full(b - a, 256, np.uint16)  # 256: before and after the text
                near[max(-a, 0) : n - a] = symbols[max(a, 0) : b]
                places = (at - a)[None, :] + self.block * np.arange(3)[:, None]
                one = _triple(*self.hasher(near, places.ravel(), places.ravel() + self.block).reshape(places.shape))
                two = _triple(*rolling(near, self.block)[places])
                # A period holds as many sampled positions as the cover has residues.
                here, size = slice(self.step, len(at) - self.step), len(at) - 2 * self.step
                names = [_triple(*(x[k * self.step : k * self.step + size] for k in range(3))) for x in (one, two)]
                for part, value in zip(parts, (at[here], one[here], *names), strict=True):
                    part.append(value)
        return tuple(np.concatenate(p) for p in parts)


def _distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Rows (id, key, empty), and the name of the table of distinct texts that are not empty (key, copies,
    size, data), bucketed by key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slot = F.xxhash64(text).bitwiseAND(F.lit(KEY_MASK))
    digest = F.unhex(F.sha2(text, 256))
    rows = materialize(docs.select(F.col(id_col).cast("bigint").alias("id"), slot.alias("key"), digest.alias("digest"), (text == "").alias("empty")), "rows")
    shared = rows.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("key")
    several = rows.join(shared, "key").select("key", "digest").distinct()
    number = F.row_number().over(Window.partitionBy("key").orderBy("digest")) - 1
    number = F.when(number < 16, number).otherwise(F.raise_error(F.lit("more than 16 texts share a hash")).cast("int"))
    several = materialize(several.withColumn("number", number), "shared_keys")
    texts = docs.select(slot.alias("key"), text.cast("binary").alias("data"), *([] if several.isEmpty() else [digest.alias("digest")])).where(F.length("data") > 0)
    if not several.isEmpty():  # about one pair of 2e9 texts or more
        own = F.col("key").bitwiseOR(F.coalesce("number", F.lit(0)).cast("bigint"))
        rows = rows.join(several, ["key", "digest"], "left").select("id", own.alias("key"), "digest", "empty")
        texts = texts.join(several, ["key", "digest"], "left").select(own.alias("key"), "data")
    buckets = shuffle_partitions(spark)
    texts = texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"))
    texts = texts.select("key", "copies", F.length("data").cast("bigint").alias("size"), "data")
    name = f"texts_{uuid.uuid4().hex}"
    writer = texts.write.bucketBy(buckets, "key").sortBy("key")
    with freed_shuffles(spark):
        writer.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return rows.select("id", "key", "empty"), name


def _drop(spark: SparkSession, name: str) -> None:
    gone = spark.table(name)
    gone.folder = f"{shared_folder(spark)}/{name}"
    discard(gone)
    spark.sql(f"DROP TABLE {name}")


def _anchors(texts: DataFrame) -> DataFrame:
    """words (whether of words), name (hash, and the halves of the name of what is around), key, first, last of
    the least grams."""
    schema = pa.schema([("words", pa.bool_()), ("hash", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def compute(batches):
        passages = Passages()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            data, offsets = buffer_of(batch.column("data"))
            for row, end, a, b in pieces(offsets, PIECE, LENGTH):
                whole = offsets[row] == a and offsets[end] == b
                first = offsets[row:end] - a if whole else np.zeros(1, np.int64)
                last = offsets[row + 1 : end + 1] - a if whole else np.full(1, b - a)
                hashes, start, stop = byte_anchors(data[a:b], first, last)
                text = np.searchsorted(first, start, "right") - 1
                shift = first[text] if whole else int(offsets[row]) - a
                yield _batch(schema, np.zeros(len(text), bool), hashes, np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), keys[row + text], start - shift, stop - shift)
                if whole:
                    hashes, one, two, text, start, stop = passages.anchors(data[a:b], first, last)
                    yield _batch(schema, np.ones(len(text), bool), hashes, one, two, keys[row + text], start, stop)
                elif a == offsets[row]:  # of a longer text the words are read at once
                    text = data[offsets[row] : offsets[end]]
                    hashes, one, two, _, start, stop = passages.anchors(text, np.zeros(1, np.int64), np.array([len(text)]))
                    yield _batch(schema, np.ones(len(hashes), bool), hashes, one, two, np.full(len(hashes), keys[row]), start, stop)

    fields = "words boolean, hash bigint, one bigint, two bigint, key bigint, first int, last int"
    return texts.select("key", "data").mapInArrow(compute, fields)


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _stretches(anchors: DataFrame) -> DataFrame:
    """key, spans (array of first, last) of the windows of bytes that may be repeated. Written."""
    rows = anchors.where("not words").select("hash", "key", "first", "last")
    often = materialize(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    live = label_rows(rows, often, "hash", "n").groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    found = materialize(live, "stretches")
    discard(often)
    return found


def combine_samples(key: np.ndarray, position: np.ndarray, name: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a chunk as they are shuffled: key, position, name, one, two, copies, remains.

    The first of equal second-level names (one, two) stands for their number; the others are repeated and get
    names of their own. A name with several of them is replaced by one for each, and two rows without a place
    (position -1, no copies) show other chunks that it has several.
    """
    order = np.lexsort((two, one, name))
    key, position, name, one, two = (c[order] for c in (key, position, name, one, two))
    new_name = np.concatenate([[True], name[1:] != name[:-1]])
    first = new_name | np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    starts, of_name = np.flatnonzero(first), np.cumsum(new_name) - 1
    several = (np.bincount(of_name[starts]) > 1)[of_name]
    number = np.full(len(name), 2, np.int32)
    number[starts] = np.diff(np.append(starts, len(name)))
    sent = name.copy()
    sent[~first] = _own_names(key[~first], position[~first])
    remains = first & several
    sent[remains] = mix(mix(name[remains]) + one[remains])
    last = np.concatenate([new_name[1:], [True]])
    shown = np.flatnonzero(several & (new_name | last))
    none = np.zeros(len(shown), np.int64)
    back = np.argsort(order)  # in the order of texts and positions they compress better
    joined = zip(
        tuple(c[back] for c in (key, position, sent, one, two, number, remains)),
        (key[shown], none - 1, name[shown], one[shown], two[shown], none.astype(np.int32), none.astype(bool)), strict=True
    )
    return tuple(np.concatenate(pair) for pair in joined)


def combine_windows(key: np.ndarray, position: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of a chunk as they are shuffled, with the number ``copies``: the first of equal ones stands for all,
    the others are repeated and get names of their own."""
    order = np.argsort(one, kind="stable")
    same = one[order]
    if ((same[1:] == same[:-1]) & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
    key, position, one, two = (c[order] for c in (key, position, one, two))
    first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    starts = np.flatnonzero(first)
    copies = np.full(len(one), 2, np.int32)
    copies[starts] = np.diff(np.append(starts, len(one)))
    one[~first] = _own_names(key[~first], position[~first])
    back = np.argsort(order)  # in the order of texts and positions they compress better
    return tuple(c[back] for c in (key, position, one, two, copies))


def _own_names(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    return mix(mix(key.astype(np.uint64)) + position.astype(np.uint64))


def _chunks(parts, combine, schema: pa.Schema):
    """Record batches of tuples of arrays, joined to chunks of CHUNK rows (or one part) and combined."""
    held, size = [], 0

    def flush():
        columns = combine(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for k in range(0, len(columns[0]), 1 << 16):
            yield _batch(schema, *(c[k : k + (1 << 16)] for c in columns))

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _samples(texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """key, position, name, one, two (second-level name), copies, remains of the sampled suffixes."""
    schema = pa.schema(
        [("key", pa.int64()), ("position", pa.int32()), ("name", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("copies", pa.int32()), ("remains", pa.bool_())]
    )

    def compute(batches):
        sampler = Sampler()

        def parts():
            for batch in batches:
                for key, data, spans in zip(*(batch.column(c) for c in ("key", "data", "spans")), strict=True):
                    first, last = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    at, *names = sampler(_bytes(data.as_buffer()), *union(first, last))
                    yield np.full(len(at), key.as_py()), at, *names

        yield from _chunks(parts(), combine_samples, schema)

    rows = texts.join(stretches.hint("merge"), "key").select("key", "data", "spans")
    return rows.mapInArrow(compute, "key bigint, position int, name bigint, one bigint, two bigint, copies int, remains boolean")


def _marks(samples: DataFrame) -> DataFrame:
    """key, settled, open: positions of the sampled suffixes whose windows are all repeated, and of those
    whose windows are to be compared."""
    of_name, of_context = Window.partitionBy("name"), Window.partitionBy("name", "one", "two")
    known = samples.withColumn("several", (F.min("one").over(of_name) != F.max("one").over(of_name)) | (F.min("two").over(of_name) != F.max("two").over(of_name)))
    known = known.withColumn("settled", F.sum("copies").over(of_context) > 1)
    known = known.withColumn("first", F.row_number().over(of_context.orderBy(F.desc("position"))) == 1)
    known = known.select("key", "position", "settled", (F.col("first") & (F.col("several") | F.col("remains"))).alias("open"))
    known = known.where("position >= 0 and (settled or open)")
    return known.groupBy("key").agg(
        F.collect_list(F.when(F.col("settled"), F.col("position"))).alias("settled"),
        F.collect_list(F.when(F.col("open"), F.col("position"))).alias("open"),
    )


def _windows_of(positions: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in which sampled suffixes lie at most PERIOD from the start, as intervals."""
    first, last = np.maximum(positions - PERIOD, 0), np.minimum(positions, size - LENGTH)
    some = first <= last
    return union(first[some], last[some])


def _remaining(texts: DataFrame, marks: DataFrame, stretches: DataFrame) -> DataFrame:
    """key, position, one, two (name), copies of the windows that remain to be compared: those around open samples
    that winnowing has not ruled out."""
    schema = pa.schema([("key", pa.int64()), ("position", pa.int32()), ("one", pa.int64()), ("two", pa.int64()), ("copies", pa.int32())])

    def compute(batches):
        hasher = SpanHasher()

        def parts():
            for batch in batches:
                for key, data, positions, spans in zip(*(batch.column(c) for c in ("key", "data", "open", "spans")), strict=True):
                    symbols = _bytes(data.as_buffer())
                    first, last = _windows_of(positions.values.to_numpy().astype(np.int64), len(symbols))
                    live = union(*(spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1)))
                    first, last = intersection(first, last, *live)
                    for low, high in zip(first.tolist(), last.tolist(), strict=True):
                        for start in range(low, high + 1, PIECE):
                            near = symbols[start : min(start + PIECE, high + 1) + LENGTH - 1]
                            at = np.arange(len(near) - LENGTH + 1)
                            yield np.full(len(at), key.as_py()), at + start, hasher(near, at, at + LENGTH), rolling(near, LENGTH)

        yield from _chunks(parts(), combine_windows, schema)

    marks = marks.where(F.size("open") > 0).select("key", "open").join(stretches, "key")
    rows = texts.join(marks.hint("merge"), "key")
    return rows.select("key", "data", "open", "spans").mapInArrow(compute, "key bigint, position int, one bigint, two bigint, copies int")


def _equal(windows: DataFrame) -> DataFrame:
    """key, equal: positions of the windows that are repeated, by comparison with their neighbours in sorted order."""
    order = Window.partitionBy("one").orderBy("two")
    near = F.coalesce((F.lag("two").over(order) == F.col("two")) | (F.col("copies") > 1), F.col("copies") > 1)
    known = windows.select("key", "position", (near | F.coalesce(F.lead("two").over(order) == F.col("two"), F.lit(False))).alias("found")).where("found")
    return known.groupBy("key").agg(F.collect_list("position").alias("equal"))


def _shared_passages(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, passages (array of first, last) of the passages that another distinct text holds too. Written."""
    rows = anchors.where("words").select(F.struct("hash", "one", "two").alias("name"), "key", "first", "last")
    names = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    names = materialize(names.withColumn("hash", F.col("name.hash")), "passage_names")
    grams = names.groupBy("hash").agg(F.count(F.lit(1)).alias("n_names"), F.min("low").alias("least"), F.max("high").alias("most"))
    grams = materialize(grams.where("least <> most").select("hash", "n_names"), "passage_grams")
    shared = label_rows(names, grams, "hash", "n_names").select(
        "name", "n", "low", (F.col("low") != F.col("high")).alias("settled"), (F.col("n_names") > 1).alias("several")
    )
    shared = materialize(shared, "passage_names")
    known = label_rows(rows, shared, "name", "n")
    is_open = F.col("several") & (~F.col("settled") | (F.col("key") == F.col("low")))
    known = known.select("key", "first", "last", "settled", is_open.alias("open")).where("settled or open")
    span = F.struct("first", "last")
    marks = known.groupBy("key").agg(F.collect_list(F.when(F.col("settled"), span)).alias("settled"), F.collect_list(F.when(F.col("open"), span)).alias("open"))
    marks = materialize(marks, "passage_marks")
    discard(names, grams, shared)
    schema = pa.schema([("key", pa.int64()), ("position", pa.int32()), ("one", pa.int64()), ("two", pa.int64())])

    def compute(batches):
        passages = Passages()
        for batch in batches:
            for key, data, spans in zip(*(batch.column(c) for c in ("key", "data", "open")), strict=True):
                first, last = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                at = spread(*union(first, last))
                one, two = passages.windows(_bytes(data.as_buffer()), at)
                for k in range(0, len(at), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield _batch(schema, np.full(len(at[part]), key.as_py()), at[part], one[part], two[part])

    rest = texts.join(marks.where(F.size("open") > 0).select("key", "open").hint("merge"), "key").select("key", "data", "open")
    windows = rest.mapInArrow(compute, "key bigint, position int, one bigint, two bigint")
    windows = materialize(windows.select("key", "position", F.struct("one", "two").alias("name")), "passage_windows")
    found = windows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    found = materialize(found.where("low <> high").select("name", "n"), "passages")
    equal = label_rows(windows, found, "name", "n").groupBy("key").agg(F.collect_list(F.struct(F.col("position").alias("first"), F.col("position").alias("last"))).alias("equal"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    both = F.concat("settled", F.coalesce("equal", none))
    passages = materialize(marks.join(equal, "key", "left").select("key", both.alias("passages")).where(F.size("passages") > 0), "passages")
    discard(marks, windows, found)
    return passages


def _removed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, spans (removed runs: start, end) and n_passage_words of the texts in which something was found (settled,
    equal, passages)."""

    def compute(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            keys, spans, words = [], [], []
            for key, size, settled, equal, passages in zip(*(batch.column(c) for c in ("key", "size", "settled", "equal", "passages")), strict=True):
                a = _windows_of(settled.values.to_numpy().astype(np.int64), size.as_py()) if settled.is_valid else (none, none)
                b = equal.values.to_numpy().astype(np.int64) if equal.is_valid else none
                first, last = union(np.concatenate([a[0], b]), np.concatenate([a[1], b]) + LENGTH - 1)
                keys.append(key.as_py())
                spans.append(np.stack([first, last + 1], 1).tolist())
                first, last = (passages.values.field(k).to_numpy().astype(np.int64) for k in (0, 1)) if passages.is_valid else (none, none)
                first, last = union(first, last + PASSAGE - 1)
                words.append(int((last - first + 1).sum()))
            types = pa.int64(), pa.list_(pa.list_(pa.int64())), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, spans, words), types, strict=True)], names=["key", "spans", "n_passage_words"])

    joined = found.join(texts.select("key", "size"), "key").select("key", "size", "settled", "equal", "passages")
    return joined.mapInArrow(compute, "key bigint, spans array<array<bigint>>, n_passage_words bigint")


def _cleaned(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """key, copies, n_bytes, n_removed, n_passage_words, spans (removed runs: start, end) and kept of every text."""
    none = F.array().cast("array<array<bigint>>")
    rows = texts.join(removed.hint("merge"), "key", "left")
    copied = F.col("copies") > 1
    whole = F.array(F.array(F.lit(0).cast("bigint"), F.col("size")))
    spans = F.when(copied & (F.col("size") >= LENGTH), whole).otherwise(F.coalesce("spans", none))
    words = F.when(copied, _n_words(F.col("data"))).otherwise(F.lit(0))
    words = F.when(words >= PASSAGE, words).otherwise(F.coalesce("n_passage_words", F.lit(0))).cast("bigint")
    rows = rows.select("key", "copies", F.col("size").alias("n_bytes"), "data", spans.alias("spans"), words.alias("n_passage_words"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s[1]))  # where kept runs begin
    starts = F.concat(F.transform("spans", lambda s: s[0]), F.array("n_bytes"))  # and end
    runs = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("data"), (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    kept = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.array_join(runs, "").cast("binary"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return rows.select("key", "copies", "n_bytes", gone.alias("n_removed"), "n_passage_words", "spans", kept.alias("kept"))


def _n_words(data: Column) -> Column:
    return F.size(F.filter(F.split(data.cast("string"), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, empty), and for each key of a text that is not empty: copies, n_bytes, n_removed,
    n_passage_words, spans (removed runs, start and end) and kept (the remaining bytes), or columns ``result``
    made of these. All intermediate tables are gone when it returns."""
    spark = docs.sparkSession
    rows, name = _distinct_texts(docs, id_col, text_col)
    texts = spark.table(name)
    anchors = materialize(_anchors(texts), "anchors")
    stretches = _stretches(anchors)
    passages = _shared_passages(texts, anchors)
    discard(anchors)
    marks = materialize(_marks(_samples(texts, stretches)), "marks")
    equal = materialize(_equal(_remaining(texts, marks, stretches)), "equal")
    discard(stretches)
    found = marks.select("key", "settled").join(equal, "key", "left").join(passages, "key", "full")
    removed = materialize(_removed(texts, found), "removed")
    discard(marks, equal, passages)
    cleaned = materialize(_cleaned(texts, removed).select(*(result or ["*"])), "cleaned")
    discard(removed)
    _drop(spark, name)
    return rows, cleaned


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 400 bytes from every text of ``documents``."""
    result = [F.col(c) for c in ("key", "copies", "n_bytes", "n_removed", "n_passage_words")]
    result += [F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    rows, digests = remove_repeats(table(spark, sf_dir, "documents"), result=result)
    counts = ["n_bytes", "n_removed", "n_spans", "n_passage_words"]
    empty = rows.where("empty").select(
        F.col("id").alias("doc_id"), *(F.lit(0).cast("bigint").alias(c) for c in counts), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")
    )
    full = label_rows(rows.where("not empty"), digests, "key", "copies")
    return full.select(F.col("id").alias("doc_id"), *counts, "kept_sha256").unionByName(empty)
