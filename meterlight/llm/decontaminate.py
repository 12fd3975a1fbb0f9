"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words into lower
case. Windows of template tokens are hash-joined with those of the benchmark, so a question whose
numbers and names were exchanged still meets its original. Along each alignment (document position
less item position) the slots must be filled consistently: a value of the item stands for one value of
the document, and different values for different ones. A document is contaminated by an item if enough
of the item's windows are found on consistent alignments.

The benchmark's windows are broadcast in blocks of a fixed number, as many passes as there are blocks;
documents are read whole and only their matches are shuffled.

Numbers are runs of digits, with points and commas between digits. Names are capitalised words that do
not begin a sentence (and, within an item, capitalised occurrences of the same words elsewhere in it);
consecutive names are one slot. Documents are read with the capitals at the start of sentences both as
literal words and as names, so text around a passage cannot change what matches it. Units are the words of UNITS after a number.

Defined cases: null and empty texts match nothing, nor do items of fewer than ``window`` tokens or
without a window of enough literal words. Repeated documents and items are reported under their ids; an
item id that is null is kept as null. Rows that share id and text are one document. Other columns are
not read. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, keyed, materialize, named, table, text_key, worker_cache
from .hashing import HashArray, SpanHasher, mix, powers

#: Template tokens in a window, and how many of them must be literal words.
WINDOW, LITERAL = 5, 3
#: Share of an item's windows that must be found, and of slot fillings that must be consistent.
COVERAGE, CONSISTENT = 0.5, 0.8
#: Windows of the benchmark that are broadcast at once.
BLOCK = 2_000_000
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre"
    " kilometres centimeter centimeters mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces"
    " ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month"
    " months year years degree degrees percent usd eur dollar dollars euro euros cent cents mph kmh watt watts volt volts hz"
).split()

OTHER, LETTER, DIGIT, STOP, JOINER = 0, 1, 2, 3, 4
NUMBER_CODE, NAME_CODE, UNIT_CODE = (mix(np.array([k], np.uint64))[0] for k in (11, 12, 13))


class Templates:
    """Turns texts into template tokens."""

    def __init__(self, window: int, literal: int):
        self.window, self.literal = window, literal
        self.kind, self.lower, self.upper = worker_cache("template_tables", _tables)
        self.hasher = SpanHasher()
        units = [np.frombuffer(u.encode("utf-32-le"), "<u4") for u in UNITS]
        self.units = np.array([self.hasher(u, np.array([0]), np.array([len(u)]))[0] for u in units], np.uint64)
        self.powers = powers(window)

    def _words(self, text: str) -> dict[str, np.ndarray] | None:
        """The words and numbers of a text: value, number, unit, capital (and no shout), first of its sentence."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[points]
        inner = np.flatnonzero((points[1:-1] == 44) | (points[1:-1] == 46)) + 1  # points and commas between digits
        inner = inner[(kind[inner - 1] == DIGIT) & (kind[inner + 1] == DIGIT)]
        if len(inner):
            kind = kind.copy()
            kind[inner] = DIGIT
        word = (kind == LETTER) | (kind == DIGIT)
        edge = np.empty(len(points) + 1, bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = kind[1:] != kind[:-1]
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        own = word[starts]
        starts, ends = starts[own], ends[own]
        if not len(starts):
            return None
        value = self.hasher(self.lower[points], starts, ends)
        number = kind[starts] == DIGIT
        capital = self.upper[points[starts]] & ~number
        stops = np.concatenate([[0], np.cumsum(kind == STOP)])
        first = np.ones(len(starts), bool)  # of its sentence: a stop or nothing lies before it
        first[1:] = stops[starts[1:]] > stops[ends[:-1]]
        shout = capital & (ends - starts > 1) & self.upper[points[np.minimum(starts + 1, len(points) - 1)]]
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & np.isin(value[1:], self.units)
        return {"value": value, "number": number, "unit": unit, "capital": capital & ~shout, "first": first}

    def _names(self, words: dict[str, np.ndarray]) -> np.ndarray:
        """Capitalised words within sentences, and the same words at the start of sentences."""
        value, capital = words["value"], words["capital"]
        name = capital & ~words["first"]
        if name.any():
            name |= capital & np.isin(value, value[name])
        return name

    def _template(self, words: dict[str, np.ndarray], name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and slots of the tokens, and the word that each begins with."""
        value, number, unit = words["value"], words["number"], words["unit"]
        name = name & ~unit
        code = np.where(number, NUMBER_CODE, np.where(unit, UNIT_CODE, np.where(name, NAME_CODE, value)))
        slot = np.where(number | unit | name, value, np.uint64(0))
        again = np.zeros(len(value), bool)
        again[1:] = name[1:] & name[:-1]
        heads = np.flatnonzero(~again)
        if name.any():  # consecutive names: one slot, whose value is made of all (and alike if there is one)
            code, slot = code[heads], np.where(name[heads], mix(np.add.reduceat(slot, heads)), slot[heads])
        return code, slot, heads

    def _windows(self, code: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the windows with enough literal words."""
        n = len(code) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        value = np.zeros(n, np.uint64)
        literal = np.zeros(n, np.int8)
        for k in range(self.window):
            value += code[k : k + n] * self.powers[k]
            literal += slot[k : k + n] == 0
        at = np.flatnonzero(literal >= self.literal)
        return mix(value[at]), at

    def windows(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and positions of the windows with enough literal words, and all slot values, of a
        text that is taken by itself (an item)."""
        words = self._words(text) if text else None
        if words is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        code, slot, _ = self._template(words, self._names(words))
        return *self._windows(code, slot), slot

    def passages(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, positions and slot values (a row each) of the windows of a text that may hold items:
        with the capitals at the start of sentences as literal words, and as names, so that no other part of
        the text decides what they are. Windows in which some of them are names elsewhere in the text and
        others are not come so, too. Positions are those of the first reading."""
        words = self._words(text) if text else None
        if words is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, self.window), np.uint64)
        capital, first, offsets = words["capital"], words["first"], np.arange(self.window)
        code, slot, heads = self._template(words, capital & ~first)
        hashes, at = self._windows(code, slot)
        parts = [(hashes, at, slot[at[:, None] + offsets])]
        if (capital & first).any():
            plain_hash = np.zeros(len(code), np.uint64)
            plain_hash[at] = hashes
            token = np.zeros(len(capital), np.int64)  # of the first reading, by word
            token[heads[1:]] = 1
            token = np.cumsum(token)
            own = self._names(words)
            named, plain = own & first, capital & ~own
            for name in (capital, own) if named.any() and plain.any() else (capital,):
                code, slot, heads = self._template(words, name)
                hashes, at = self._windows(code, slot)
                ends = np.append(heads, len(capital))
                place = token[ends[at + self.window] - 1] - (self.window - 1)
                new = plain_hash[place] != hashes
                if name is own:
                    for some in (named, plain):
                        sums = np.concatenate([[0], np.cumsum(some)])
                        new &= sums[ends[at + self.window]] > sums[ends[at]]
                parts.append((hashes[new], place[new], slot[at[new][:, None] + offsets]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isdigit():
            kind[c] = DIGIT
        elif ch.isalpha():
            kind[c] = LETTER
            small = ch.lower()
            if small != ch:
                upper[c] = True
                lower[c] = ord(small) if len(small) == 1 else c
    for ch in ".!?:\n\r":
        kind[ord(ch)] = STOP
    return kind, lower, upper


def _matches(rows: DataFrame, window: int, literal: int, wanted=None) -> DataFrame:
    """id, text_key, hash, position, slots (values within the window) of the windows of every item;
    with ``wanted`` (a broadcast sorted array) of the passages of documents whose hash is in it."""

    def compute(batches):
        maker, lookup = Templates(window, literal), None
        if wanted is not None:
            lookup = HashArray(wanted.value, np.zeros((len(wanted.value), 0)))
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for k, text in enumerate(batch.column("text")):
                if lookup is None:
                    hashes, at, slot = maker.windows(text.as_py())
                    slots = slot[at[:, None] + np.arange(window)]
                else:
                    hashes, at, slots = maker.passages(text.as_py())
                    hit = lookup.find(hashes) >= 0
                    hashes, at, slots = hashes[hit], at[hit], slots[hit]
                if len(hashes):
                    for column, found in zip(columns, (np.full(len(at), k), hashes, at, slots.ravel()), strict=True):
                        column.append(found)
            if not columns[0]:
                continue
            row, hashes, at, slots = (np.concatenate(c) for c in columns)
            taken = batch.select(["id", "text_key"]).take(pa.array(row))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(slots) + 1, window, dtype=np.int32)), pa.array(slots.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(hashes.view(np.int64)), pa.array(at), lists], names=["id", "text_key", "hash", "position", "slots"]
            )

    return rows.mapInArrow(compute, "id bigint, text_key bigint, hash bigint, position bigint, slots array<bigint>")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, literal: int = LITERAL, coverage: float = COVERAGE, consistent: float = CONSISTENT, block: int = BLOCK,
) -> DataFrame:
    """Contaminated documents with the items found: id, text_key, item_id, n_windows (found),
    item_windows, coverage, reparameterised (some slot has another value than the item's)."""
    items = _matches(_texts(benchmark, item_col, item_text_col), window, literal)
    items = materialize(
        items.groupBy(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "hash")
        .agg(F.min(F.struct("position", "slots")).alias("at"))
        .select("item_id", "item_key", "hash", F.col("at.position").alias("item_position"), F.col("at.slots").alias("item_slots")),
        "items",
    )
    sizes = items.groupBy("item_id", "item_key").agg(F.count(F.lit(1)).alias("item_windows"))
    hashes = materialize(items.select("hash").distinct(), "windows")
    blocks = max(1, -(-hashes.count() // block))
    texts = _texts(docs, id_col, text_col)
    found = None
    for k in range(blocks):  # one pass over the documents for each block of the benchmark
        part = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k).toArrow()["hash"].to_numpy()
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(part.view(np.uint64)))
        hits = _matches(texts, window, literal, wanted)
        found = hits if found is None else found.unionByName(hits)
    found = materialize(found, "hits")

    key = ["id", "text_key", "item_id", "item_key"]
    joined = found.join(F.broadcast(items), "hash") if items.count() <= block // 20 else join_spread(found, items, "hash")
    joined = joined.withColumn("shift", F.col("position") - F.col("item_position"))
    same = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("item"), d.alias("doc")))
    slots = joined.select(*key, "shift", F.explode(F.filter(same, lambda s: s["item"] != 0)).alias("s"))
    filled = slots.groupBy(*key, "shift", "s").agg(F.count(F.lit(1)).alias("n"))
    best = filled.groupBy(*key, "shift", "s.item").agg(F.sum("n").alias("n"), F.max(F.struct("n", "s.doc")).alias("best"))
    along = best.groupBy(*key, "shift").agg(
        (F.sum("best.n") / F.sum("n")).alias("agreeing"),
        (F.countDistinct("best.doc") / F.count(F.lit(1))).alias("different"),
        F.max(F.col("item") != F.col("best.doc")).alias("exchanged"),
    ).withColumnRenamed("shift", "along_shift")
    aliased = along.select(*[F.col(c).alias("k_" + c) for c in key], "along_shift", "agreeing", "different", "exchanged")
    condition = F.col("shift") == F.col("along_shift")
    for c in key:
        condition &= F.col(c).eqNullSafe(F.col("k_" + c))
    windows = joined.select(*key, "hash", "shift").join(aliased, condition, "left")
    windows = windows.where(F.col("agreeing").isNull() | ((F.col("agreeing") >= consistent) & (F.col("different") >= consistent)))
    per_window = windows.groupBy(*key, "hash").agg(F.min(F.coalesce("exchanged", F.lit(False))).alias("exchanged"))
    counted = per_window.groupBy(*key).agg(F.count(F.lit(1)).alias("n_windows"), F.max("exchanged").alias("reparameterised"))
    sizes = sizes.select(F.col("item_id").alias("s_item"), F.col("item_key").alias("s_key"), "item_windows")
    counted = counted.join(sizes, F.col("item_id").eqNullSafe(F.col("s_item")) & (F.col("item_key") == F.col("s_key")))
    return counted.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage).select(
        "id", "text_key", "item_id", "n_windows", "item_windows", "coverage", "reparameterised"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    bad = contaminated(docs, benchmark, id_col, text_col, **parameters).select("id", "text_key").distinct()
    tagged = keyed(docs, id_col, text_key(F.col(text_col)))
    return tagged.join(named(bad, "id", "text_key"), ["key", "id", "no_id"], "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that hold items of ``benchmark``, a row for each pair."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "item_windows", "coverage", "reparameterised")
