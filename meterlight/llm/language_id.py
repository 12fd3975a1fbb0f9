"""Language identification with interpolated Kneser-Ney character models.

One model per language, of characters in lower case, runs of anything but letters being one space.
The models lie in sorted hash arrays: for each order the sorted 64-bit hashes of all n-grams seen in
any language, with one column of log-probabilities per language (where a language has not seen the
n-gram, its interpolated value), and the sorted hashes of the contexts with one column of back-off
weights per language. A text gets the language of the lowest length-normalised cross-entropy. It is
rejected where that entropy is further above the language's own than a calibrated bound.

The models are fitted on ``sample`` whole documents per language, those with the least hash of id and text, repeated rows once;
this bounds the model, which is broadcast. Prediction reads every whole text, in blocks, without a
shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; without any
labelled text, all are. Rows without a language are not learned from. A null id counts as the empty
string where ids are hashed. Ties go to the alphabetically first language. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table, worker_cache
from .hashing import HashArray

UNKNOWN = "und"
#: Length of the n-grams, and labelled documents per language that are learned from.
ORDER, SAMPLE = 4, 400
#: How many times as many documents are drawn by hash before the sample is ranked.
MARGIN = 4
#: Letters scored at once.
BLOCK = 1 << 19
#: Share of the sample that calibration may reject, and the factor put on the bound so found. A text is
#: kept in any case while its entropy is below this share of the way from the language's own entropy to
#: that of letters drawn at random, so that a text with passages in other languages stays.
REJECTED_SHARE, SLACK, KEPT_SHARE = 0.001, 2.0, 0.6


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            small = ch.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    return lower


def normalise(text: str, lower: np.ndarray) -> np.ndarray:
    """Code points of the letters, in lower case, with a 0 for each run of other characters between."""
    points = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    points = points[keep]
    return points[:-1] if len(points) and points[-1] == 0 else points


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all n-grams of one order."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    value = np.full(n, order, np.uint64)
    for k in range(order):
        value = value * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> dict:
    """Fit the models. ``counts``: per language the n-grams of the highest order with their counts;
    a space stands for anything but letters, and leading spaces for the start of a text."""
    languages = sorted(counts)
    probs: list[list[dict[str, float]]] = []
    gammas: list[list[dict[str, float]]] = []
    floors = []
    for lang in languages:
        levels = [dict(counts[lang])]  # highest order first, then continuation counts
        for _ in range(order - 1):
            lower: dict[str, int] = {}
            for gram in levels[-1]:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            levels.append(lower)
        levels.reverse()  # levels[k]: n-grams of k + 1 characters
        floor = 1.0 / (len(levels[0]) + 1)
        p_by_level, g_by_level = [], []
        for k, level in enumerate(levels):
            ones = sum(1 for c in level.values() if c == 1)
            twos = sum(1 for c in level.values() if c == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for gram, c in level.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + c
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            gamma = {h: discount * kinds[h] / total[h] for h in total}
            below = p_by_level[-1] if k else {}
            p_by_level.append({
                g: (c - discount) / total[g[:-1]] + gamma[g[:-1]] * (below[g[1:]] if k else floor) for g, c in level.items()
            })
            g_by_level.append(gamma)
        probs.append(p_by_level)
        gammas.append(g_by_level)
        floors.append(floor)

    def backed_off(lang: int, gram: str) -> float:
        weight = 1.0
        while gram:
            p = probs[lang][len(gram) - 1].get(gram)
            if p is not None:
                return weight * p
            weight *= gammas[lang][len(gram) - 1].get(gram[:-1], 1.0)
            gram = gram[1:]
        return weight * floors[lang]

    def hashed(strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0, np.uint64)
        flat = np.frombuffer("".join(strings).replace(" ", "\0").encode("utf-32-le"), "<u4").reshape(len(strings), -1)
        return np.concatenate([gram_hashes(row, flat.shape[1]) for row in flat]) if flat.shape[1] else np.zeros(0, np.uint64)

    tables = []
    for k in range(order):
        grams = sorted(set().union(*(p[k] for p in probs)))
        contexts = sorted(set().union(*(g[k] for g in gammas)))
        values = np.log([[backed_off(x, g) for x in range(len(languages))] for g in grams]).reshape(len(grams), len(languages))
        weights = np.log([[gammas[x][k].get(h, 1.0) for x in range(len(languages))] for h in contexts])
        if k:
            tables.append((hashed(grams), values, hashed(contexts), weights.reshape(len(contexts), len(languages))))
        else:
            tables.append((hashed(grams), values, None, weights[0]))
    return {"languages": languages, "order": order, "tables": tables, "floor": np.log(floors)}


class Scorer:
    """Looks texts up in fitted models."""

    def __init__(self, model: dict):
        self.languages, self.order = model["languages"], model["order"]
        self.grams = [HashArray(t[0], t[1]) for t in model["tables"]]
        self.contexts = [HashArray(t[2], t[3]) if t[2] is not None else None for t in model["tables"]]
        self.last = (model["tables"][0][3] + model["floor"]).astype(np.float32)
        self.bounds = model.get("bounds")
        self.random = -model["floor"]
        self.lower = worker_cache("letters", _letters)

    def _scores(self, points: np.ndarray) -> np.ndarray:
        """Log-probabilities by language of every character but the first order - 1."""
        order = self.order
        n = len(points) - order + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        rows = self.grams[order - 1].find(gram_hashes(points, order))
        out[:] = self.grams[order - 1].values[rows] if len(self.grams[order - 1].keys) else 0
        missing = np.flatnonzero(rows < 0)
        out[missing] = 0
        for k in range(order - 1, 0, -1):  # back off from order k + 1 to order k
            if not len(missing):
                return out
            shift = order - 1 - k  # n-grams of order k + 1 that end at the same character start here
            contexts = gram_hashes(points, k)[missing + shift]
            rows = self.contexts[k].find(contexts)
            seen = rows >= 0
            out[missing[seen]] += self.contexts[k].values[rows[seen]]
            rows = self.grams[k - 1].find(gram_hashes(points, k)[missing + shift + 1])
            seen = rows >= 0
            out[missing[seen]] += self.grams[k - 1].values[rows[seen]]
            missing = missing[~seen]
        out[missing] += self.last
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: summed log-probabilities by language, characters scored, summed squares of the
        best language's log-probabilities."""
        pad = np.zeros(self.order - 1, np.uint32)
        sums = np.zeros((len(texts), len(self.languages)))
        squares = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush():
            if not held:
                return
            scores = self._scores(np.concatenate(held))
            at = 0
            for owner, piece in zip(owners, held, strict=True):
                own = scores[at : at + len(piece) - self.order + 1]
                sums[owner] += own.sum(axis=0, dtype=np.float64)
                squares[owner] += np.einsum("ij,ij->j", own, own, dtype=np.float64)
                at += len(piece)
            held.clear()
            owners.clear()

        waiting = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            points = normalise(text, self.lower)
            if not points.any():
                continue
            if points[0] == 0:
                points = points[1:]
            points = np.concatenate([pad, points, pad[:1]])
            sizes[i] = len(points) - self.order + 1
            for start in range(0, sizes[i], BLOCK):
                piece = points[start : start + BLOCK + self.order - 1]
                held.append(piece)
                owners.append(i)
                waiting += len(piece)
                if waiting >= BLOCK:
                    flush()
                    waiting = 0
        flush()
        return sums, sizes, squares

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score (0 to 1), cross-entropy per character and whether it is rejected."""
        sums, sizes, _ = self.totals(texts)
        found = []
        for total, size in zip(sums, sizes.tolist(), strict=True):
            if not size:
                found.append((UNKNOWN, 0.0, None, True))
                continue
            entropy = -total / size
            best = int(entropy.argmin())
            score = 1.0 / float(np.exp((entropy[best] - entropy) * min(size, 64)).sum())
            mean, by_text, by_character = self.bounds[best]
            bound = mean + max(by_text + by_character / size**0.5, KEPT_SHARE * (self.random[best] - mean))
            found.append((self.languages[best], score, float(entropy[best]), bool(entropy[best] > bound)))
        return found


def calibrate(languages: list[str], found: dict) -> np.ndarray:
    """Per language: mean entropy, and the bound's parts for a text as such and per character.

    ``found``: for each text its lang and, by that language's model, the summed log-probabilities
    (total), their number (size) and summed squares (square)."""
    total, size, square = (np.array(found[k], float) for k in ("total", "size", "square"))
    bounds = np.zeros((len(languages), 3))
    for k, lang in enumerate(languages):
        own = np.array([x == lang for x in found["lang"]], bool) & (size > 0)
        if not own.any():
            bounds[k] = 20, 0, 0
            continue
        n = size[own]
        entropy = -total[own] / n
        mean = float(np.average(entropy, weights=n))
        spread = float(np.sqrt(max(np.average((entropy - mean) ** 2, weights=n), 1e-6)))
        noise = float(np.sqrt(max(square[own].sum() / n.sum() - mean**2, 1e-6)))
        z = np.quantile((entropy - mean) / (spread + noise / np.sqrt(n)), 1 - REJECTED_SHARE)
        z = SLACK * max(float(z), 3.0)
        bounds[k] = mean, z * spread, z * noise
    return bounds


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, sample: int = SAMPLE) -> dict:
    """Models and calibration from ``sample`` documents per language."""
    spark = labelled.sparkSession
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text")
    ).where("lang is not null and text is not null")
    # Of a few times as many texts as are wanted, chosen by hash, those of the least hashes: no task meets a language.
    hashed = rows.withColumn("h", F.xxhash64("key", "text"))
    # Different texts are counted, not rows: else a language of few texts that repeat often would get none of them.
    counted = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.collect()}  # as many as the model has languages
    if not sizes:
        return {"languages": []}
    wanted = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, MARGIN * (sample + MARGIN) / n))])
    few = hashed.where((F.col("h") / 2.0**64 + 0.5) <= F.try_element_at(wanted, F.col("lang")))
    few = few.groupBy("lang", "key", "h").agg(F.first("text").alias("text"))  # repeated rows once
    few = materialize(few, "candidates")
    first = Window.partitionBy("lang").orderBy("h", "key")
    texts = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "text")
    texts = materialize(texts.repartition(shuffle_partitions(spark)), "sample")

    def count(batches):
        lower = worker_cache("letters", _letters)
        pad = np.zeros(order - 1, np.uint32)
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = normalise(text, lower)
                if not points.any():
                    continue
                points = np.concatenate([pad, points[1:] if points[0] == 0 else points, pad[:1]])
                whole = points.astype("<u4").tobytes().decode("utf-32-le").replace("\0", " ")
                for i in range(len(whole) - order + 1):
                    key = lang, whole[i : i + order]
                    found[key] = found.get(key, 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "gram": [k[1] for k in keys], "n": pa.array(found.values(), pa.int64())})

    grams = texts.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in zip(*grams.toArrow().to_pydict().values(), strict=True):
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return {"languages": []}
    model = kneser_ney(counts, order)
    model["bounds"] = _calibrated(spark, model, texts)
    return model


def _calibrated(spark: SparkSession, model: dict, texts: DataFrame) -> np.ndarray:
    """Entropies of the sample, computed where its texts are; only sums come to the driver."""
    shared = spark.sparkContext.broadcast(model)
    languages = model["languages"]

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            sums, sizes, squares = scorer.totals(batch.column("text").to_pylist())
            own = [languages.index(x) for x in labels]
            yield pa.RecordBatch.from_pydict({
                "lang": labels,
                "total": [float(sums[i, k]) for i, k in enumerate(own)],
                "size": sizes.tolist(),
                "square": [float(squares[i, k]) for i, k in enumerate(own)],
            })

    found = texts.select("lang", "text").mapInArrow(score, "lang string, total double, size bigint, square double").toArrow().to_pydict()
    return calibrate(languages, found)


def predict(docs: DataFrame, model: dict, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected (each name after ``prefix``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + n for n in ("lang_pred", "score", "cross_entropy", "rejected")]
    rest = docs.drop(*names)

    def compute(batches):
        scorer = None
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            if not shared.value["languages"]:
                found = [(UNKNOWN, 0.0, None, True)] * len(texts)
            else:
                scorer = scorer or Scorer(shared.value)
                found = scorer.predict(texts)
            types = pa.string(), pa.float64(), pa.float64(), pa.bool_()
            more = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    new = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True))
    return rest.mapInArrow(compute, f"{fields}, {new}")


def held_out(id_col: str, folds: int, fold: int):
    """Whether the CRC-32 of the id, as text, leaves the remainder ``fold``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
