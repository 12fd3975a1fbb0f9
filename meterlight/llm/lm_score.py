"""Language-model scoring with an Elias-Fano n-gram trie.

``op10`` and :func:`train_and_score` keep every word and every n-gram, in shards of the trie (:mod:`ngram_shards`). :func:`train` and
:func:`score` are for a model of bounded size that is learnt once and then broadcast; all that follows is about these.

Counts are taken over all training documents. Words of at least a share VOCABULARY of all tokens (so at
most 1 / VOCABULARY words, whatever the corpus) have ids of their own; the others form one class, whose
probability the n-gram model gives and within which a word has its smoothed unigram probability, from
the full word counts. Bigrams and trigrams of ids are kept from a share GRAMS of all tokens on (at most
1 / GRAMS of each order); the mass of what is not kept goes to the lower order, so every distribution
sums to one. Absolute discounting, interpolated. The kept n-grams make up a trie of Elias-Fano levels
with 8-bit probabilities, small enough by these bounds to be broadcast and mapped by each worker.

The counts of rare words are never gathered: a text's rare words are joined with them by hash. By the
bound on the vocabulary no key of that join has more than a share VOCABULARY of the training tokens.

Texts are read twice: once to count words, and once to write every text as the ids of its words, from which
bigrams, trigrams and scores are made. With ``vocabulary=0, grams=0`` nothing is cut: every word has an id and
every n-gram is kept, which suits corpora whose n-grams fit a worker's memory map.

Words are told apart by 64-bit hashes. Defined cases: a null text is empty, it has one token, the end;
every row is scored by itself, repeated ones too; a null id counts as the empty string
where ids are hashed; other columns are not read. Without training documents every text has base score
zero per token. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_shards
from .common import buffer_of, discard, materialize, table
from .elias_fano import Trie
from .hashing import HashArray, SpanHasher, long_words, mix, runs, words_of
from .language_id import held_out

#: Least share of all tokens for a word to have an id, and for a bigram or trigram to be kept.
VOCABULARY, GRAMS = 1e-6, 2e-7
DISCOUNT, ALPHA = 0.75, 0.1
#: Bytes of text hashed at once, bytes of texts worked on at once, and n-grams that a task adds up before it hands them on.
CHUNK, TEXTS, HELD = 1 << 18, 1 << 22, 1 << 21
END = mix(np.array([7], np.uint64))[0]
#: Bits of an id in a packed n-gram.
ID_BITS = 31


class Tokens:
    """Hashes of the tokens of texts: lower-cased words, then the end."""

    def __init__(self):
        self.hasher = SpanHasher()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in order, and the number of each text's tokens."""
        data, offsets = buffer_of(texts)
        found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, end in runs(offsets, CHUNK):
            a, b = offsets[row], offsets[end]
            part = np.frombuffer(data[a:b].tobytes().lower(), np.uint8)
            if end - row == 1:
                words = long_words(part, self.hasher, CHUNK)
                count = np.array([len(words)])
            else:
                words, count = words_of(part, offsets[row:end] - a, offsets[row + 1 : end + 1] - a, self.hasher)
            found.append(words)
            sizes.append(count)
        size = np.concatenate(sizes)
        return np.insert(np.concatenate(found), np.cumsum(size), END), size + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _counted(rows: DataFrame, column: str, keys_of) -> DataFrame:
    """hash, n: occurrences of the 64-bit keys that ``keys_of`` makes of arrays of ``column``. Tasks add up what
    they meet before it is shuffled."""

    def compute(batches):
        make = keys_of()
        waiting: list[np.ndarray] = []
        size = 0

        def out():
            keys = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["hash", "n"])

        for batch in batches:
            values = batch.column(column)
            for start, end in runs(buffer_of(values)[1], TEXTS):
                keys = make(values.slice(start, end - start))
                if len(keys):
                    waiting.append(keys)
                    size += len(keys)
                if size >= HELD:
                    yield from out()
                    waiting, size = [], 0
        if waiting:
            yield from out()

    pairs = rows.select(column).mapInArrow(compute, "hash bigint, n bigint")
    return pairs.groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The frequent words' sorted hashes with ids and counts, and the trie. Its fields are broadcast as a dict,
    since executors need no copy of this package."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    other: int  # id of the class of all other words; the start of a text has the id after it
    trie: bytes
    train_tokens: int
    train_types: int
    other_tokens: int
    other_types: int


class Vocabulary:
    def __init__(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, other: int):
        self.index = HashArray(hashes, np.zeros((len(hashes), 0)))
        self.ids, self.counts, self.other = ids, counts, other

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens, and their rows in the table of frequent words (-1: not frequent)."""
        rows = self.index.find(tokens)
        if not len(self.ids):
            return np.full(len(tokens), self.other, np.int64), rows
        return np.where(rows < 0, self.other, self.ids[rows]), rows


def _padded(ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its id and the ids of the one and the two before it; texts begin with two starts."""
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    one = np.concatenate([[start], ids[:-1]])
    one[begin] = start
    two = np.concatenate([[start], one[:-1]])
    two[begin] = start
    return ids, one, two


def _encoded(rows: DataFrame, model: Model) -> DataFrame:
    """Every row (id, text and train) written as row (a number of its own), id, train, n_tokens, n_frequent (tokens
    with an id), log_counts (their summed log10 of count + ALPHA), ids, and rare: the hash and number of each of its other words."""
    shared = rows.sparkSession.sparkContext.broadcast({k: getattr(model, k) for k in ("hashes", "ids", "counts", "other")})

    def compute(batches):
        tokens, vocabulary = Tokens(), Vocabulary(**shared.value)
        logs_of = np.append(np.log10(vocabulary.counts + ALPHA), 0.0)  # the last for words without an id
        names = ["row", "id", "train", "n_tokens", "n_frequent", "log_counts", "ids", "rare_hash", "rare_n"]
        for batch in batches:
            texts = batch.column("text")
            for start, end in runs(buffer_of(texts)[1], TEXTS):
                hashes, sizes = tokens(texts.slice(start, end - start))
                ids, rows = vocabulary(hashes)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                frequent = rows >= 0
                some = np.flatnonzero(~frequent)
                owner = np.searchsorted(begin, some, "right") - 1
                order = np.lexsort((hashes[some], owner))
                word, owner = hashes[some][order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])) if len(word) else np.zeros(0, np.int64)
                edges = pa.array(np.searchsorted(owner[new], np.arange(len(sizes) + 1)).astype(np.int32))
                lists = (
                    pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(word[new].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(np.diff(np.append(new, len(word))).astype(np.int32))),
                )
                own = [batch.column(c).slice(start, end - start) for c in ("row", "id", "train")]
                sums = pa.array(sizes), pa.array(np.add.reduceat(frequent.astype(np.int64), begin[:-1])), pa.array(np.add.reduceat(logs_of[rows], begin[:-1]))
                yield pa.RecordBatch.from_arrays([*own, *sums, *lists], names=names)

    fields = "row bigint, id bigint, train boolean, n_tokens bigint, n_frequent bigint, log_counts double, ids array<int>, rare_hash array<bigint>, rare_n array<int>"
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text").mapInArrow(compute, fields), "encoded")


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of encoded texts in order, and their number in each."""
    _, offsets = buffer_of(column)
    return column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), np.diff(offsets)


def _gram_counts(encoded: DataFrame, start: int, kept: np.ndarray | None) -> DataFrame:
    """Bigram counts or, given the kept bigrams, counts of trigrams both of whose bigrams are kept (no other can be
    as frequent), named by the place of their first bigram and their last word."""
    shared = encoded.sparkSession.sparkContext.broadcast(kept) if kept is not None else None

    def keys_of():
        lookup = None
        if shared is not None:
            lookup, place = HashArray(mix(shared.value), np.zeros((len(shared.value), 0))), np.argsort(mix(shared.value)).astype(np.uint64)
        bits = np.uint64(ID_BITS)

        def make(column):
            ids, sizes = _ids_of(column)
            if not len(ids):
                return np.zeros(0, np.uint64)
            word, one, _ = (x.astype(np.uint64) for x in _padded(ids, sizes, start))
            pair = one << bits | word
            if lookup is None:
                return pair
            found = lookup.find(mix(pair))
            before = np.concatenate([[-1], found[:-1]])
            before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = -1  # no bigram ends where a text starts
            good = (found >= 0) & (before >= 0)
            return place[before[good]] << bits | word[good]

        return make

    return _counted(encoded, "ids", keys_of)


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of at least ``least``; the caller's share of all tokens bounds their number."""
    found = counts.where(F.col("n") >= least).toArrow()
    keys, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _word_counts(rows: DataFrame) -> DataFrame:
    """hash, n: the words of the texts. Written."""

    def words():
        tokens = Tokens()
        return lambda texts: tokens(texts)[0]

    return materialize(_counted(rows, "text", words), "words")


def _vocabulary(counts: DataFrame, share: float) -> Model:
    """The model's words, without n-grams."""
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hashes, n = _frequent(counts, share * total)
    if len(n) >= (1 << ID_BITS) - 2:
        raise ValueError(f"{len(n)} words have no room in ids of {ID_BITS} bits")
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((hashes, -n))] = np.arange(len(n))
    return Model(hashes, rank, n, len(n), b"", int(total), int(types), int(total - n.sum()), int(types - len(n)))


def _fit(model: Model, counts: DataFrame, encoded: DataFrame, grams: float) -> None:
    """Give the model its trie."""
    least, start = grams * model.train_tokens, model.other + 1
    pairs, pair_counts = _frequent(_gram_counts(encoded, start, None), least)
    triples, triple_counts = _frequent(_gram_counts(encoded, start, pairs), least)
    ends = counts.where(F.col("hash") == int(END.view(np.int64))).first()
    model.trie = _build_trie(model, ends["n"] if ends else 0, pairs, pair_counts, triples, triple_counts)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: float = VOCABULARY, grams: float = GRAMS) -> tuple[Model, DataFrame]:
    """The model, and the table of all words' counts (hash, n)."""
    rows = _texts(docs, id_col, text_col).withColumn("train", F.lit(True))
    counts = _word_counts(rows)
    model = _vocabulary(counts, vocabulary)
    encoded = _encoded(rows, model)
    _fit(model, counts, encoded, grams)
    discard(encoded)
    return model, counts


def _build_trie(model: Model, texts: int, pairs, pair_counts, triples, triple_counts) -> bytes:
    """Interpolate and pack. Keys of n-grams are sorted, so parents and ids ascend."""
    size = model.other + 2
    start = model.other + 1
    mask = np.uint64((1 << ID_BITS) - 1)
    bits = np.uint64(ID_BITS)
    one = np.zeros(size)
    one[model.ids] = model.counts
    one[model.other] = model.other_tokens
    p1 = (one + ALPHA) / (model.train_tokens + ALPHA * (size - 1))
    p1[start] = p1[:start].min()  # never predicted
    context = one.copy()
    context[start] = texts

    parent, word = (pairs >> bits).astype(np.int64), (pairs & mask).astype(np.int64)
    kept = (pair_counts - DISCOUNT) / context[parent]
    rest2 = 1 - np.bincount(parent, kept, size)
    p2 = kept + rest2[parent] * p1[word]

    # Both bigrams of a kept trigram are kept.
    above, last = (triples >> bits).astype(np.int64), triples & mask
    below = np.searchsorted(pairs, (pairs[above] & mask) << bits | last) if len(triples) else above
    kept = (triple_counts - DISCOUNT) / pair_counts[above]
    rest3 = 1 - np.bincount(above, kept, len(pairs))
    p3 = kept + rest3[above] * p2[below]
    log = lambda x: np.log10(np.maximum(x, 1e-30))
    return Trie.pack([
        (None, None, log(p1), log(rest2)),
        (parent, word, log(p2), log(rest3)),
        (above, last.astype(np.int64), log(p3), None),
    ])


class Scorer:
    def __init__(self, trie: bytes, other: int):
        self.trie, self.other = Trie(trie), other

    def _gram_scores(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(word | two, one)."""
        size = np.int64(self.other + 2)
        back, pair = pd.factorize(one * size + word)
        places = self.trie.child(1, pair // size, pair % size)
        scores = np.empty(len(pair))
        hit = places >= 0
        scores[hit] = self.trie.prob(1, places[hit])
        miss = ~hit
        scores[miss] = self.trie.weight(0, (pair // size)[miss]) + self.trie.prob(0, (pair % size)[miss])
        result, place = scores[back], places[back]

        before = np.concatenate([[-1], place[:-1]])  # where the bigram before the word lies
        before[one == size - 1] = -1
        some = np.flatnonzero(before >= 0)
        back, triple = pd.factorize(before[some] * size + word[some])
        places = self.trie.child(2, triple // size, triple % size)[back]
        hit = places >= 0
        result[some[hit]] = self.trie.prob(2, places[hit])
        miss = some[~hit]
        result[miss] += self.trie.weight(1, before[miss])
        return result

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text's ids."""
        scores = self._gram_scores(*_padded(ids, sizes, self.other + 1))
        return np.add.reduceat(scores, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _scored(encoded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per encoded row: id, train, n_tokens, n_known, base_score, score."""
    rare = encoded.select("row", F.inline(F.arrays_zip("rare_hash", "rare_n"))).join(
        counts.select(F.col("hash").alias("rare_hash"), F.col("n").alias("c")), "rare_hash", "left"
    )
    sums = rare.groupBy("row").agg(
        F.sum(F.col("rare_n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("rare_log_counts"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("rare_n")).otherwise(0)).alias("rare_known"),
    )
    shared = encoded.sparkSession.sparkContext.broadcast({"trie": model.trie, "other": model.other})

    def compute(batches):
        scorer = Scorer(**shared.value)
        kept = ["row", "id", "train", "n_tokens", "n_frequent", "log_counts"]
        for batch in batches:
            values = batch.column("ids")
            for start, end in runs(buffer_of(values)[1], TEXTS):
                scores = scorer(*_ids_of(values.slice(start, end - start)))
                own = [batch.column(c).slice(start, end - start) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scores)], names=[*kept, "grams"])

    fields = "row bigint, id bigint, train boolean, n_tokens bigint, n_frequent bigint, log_counts double, grams double"
    scored = encoded.select("row", "id", "train", "n_tokens", "n_frequent", "log_counts", "ids").mapInArrow(compute, fields)
    norm = float(np.log10(model.train_tokens + ALPHA * (model.train_types + 1)))
    inner = float(np.log10(model.other_tokens + ALPHA * (model.other_types + 1)))
    rare_log, rare_known = F.coalesce("rare_log_counts", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return scored.join(sums, "row", "left").select(
        "id", "train", "n_tokens",
        (F.col("n_frequent") + rare_known).cast("bigint").alias("n_known"),
        (F.col("log_counts") + rare_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("grams") + rare_log - (F.col("n_tokens") - F.col("n_frequent")) * inner).alias("score"),
    )


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, base_score, score."""
    encoded = _encoded(_texts(docs, id_col, text_col).withColumn("train", F.lit(False)), model)
    return _scored(encoded, model, counts).drop("train")


@dataclass
class Totals:
    """What the scores of all rows have in common."""

    train_tokens: int


def train_and_score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Totals, DataFrame]:
    """All rows' scores, those of :func:`score` with ``train``, by the whole model of the rows where ``is_training`` holds: every word
    and every n-gram counts (:mod:`ngram_shards`)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    tokens, scores = ngram_shards.score_all(rows, Tokens)
    return Totals(tokens), scores


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of ``documents``; a tenth is held out of training."""
    model, scores = train_and_score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))
    return scores.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
