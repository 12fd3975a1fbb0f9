"""Interpolated trigram scores with every n-gram kept, in shards of an Elias-Fano trie.

Texts are put together in chunks of some CHUNK tokens, written once. Each chunk sends every different n-gram that it holds, with its
number of training occurrences, to the shard of the n-gram's first two words. A shard of some SHARD n-grams adds the counts up, packs what
occurs in training as two Elias-Fano levels (contexts, and below each the words that follow), looks up what the chunks have sent and
answers with counts; an answer has the order of its question, so no places are sent. Words are asked for in the same way. A chunk
then has all counts that its probabilities are made of. The bigrams go in ROUNDS parts of the shards, so that only one part's questions lie on
disk at once. Nothing is broadcast, and the driver sees the totals alone. A frequent n-gram is one entry of each chunk, however often it
occurs there.

The model: absolute discounting, interpolated, trigram to bigram to smoothed unigram. Of each context all n-grams are kept, so the lower
order's weight is the discount times the number of different words that follow, over the context's count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, discard, materialize
from .elias_fano import EliasFano
from .hashing import mix, runs

#: Tokens of a chunk, n-grams of a shard, bytes of texts worked on at once; parts in which the shards of bigrams are asked.
CHUNK, SHARD, TEXTS, ROUNDS = 1 << 20, 1 << 20, 1 << 22, 3
DISCOUNT, ALPHA = 0.75, 0.1
#: What stands before a text, and after its end.
START, AFTER = mix(np.array([8, 9], np.uint64))
ASKED = "shard bigint, source bigint, keys binary, firsts binary, sizes binary, words binary, counts binary"
SAID = "dest bigint, kind int, source bigint, first binary, second binary, third binary, tokens bigint, types bigint"
SCORES = "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, then those of 255 and more as integers of 8 bytes."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], np.int64)
    return counts


def _chunks(rows: DataFrame, tokens_of) -> DataFrame:
    """``rows`` (id, text, train) as chunks. Written. Words are places in the chunk's sorted distinct hashes."""

    def packed(held, number):
        hashes = np.concatenate([h for h, _, _, _ in held])
        sizes = np.concatenate([s for _, s, _, _ in held])
        words, codes = np.unique(hashes, return_inverse=True)
        ids, train = (pa.concat_arrays([part[k] for part in held]) for k in (2, 3))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([number], pa.int64()), pa.array([len(hashes)], pa.int64()), one(ids), one(train), one(pa.array(sizes.astype(np.int64)))]
        blobs = [pa.array([words.tobytes()], pa.binary()), pa.array([codes.astype(np.int32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *blobs], names=["chunk", "n_tokens", "ids", "train", "sizes", "words", "codes"])

    def compute(batches):
        tokens, number = tokens_of(), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text")
            for start, end in runs(buffer_of(texts)[1], TEXTS):
                hashes, sizes = tokens(texts.slice(start, end - start))
                own = (pa.array(batch.column(c).slice(start, end - start).to_pylist(), t) for c, t in (("id", pa.int64()), ("train", pa.bool_())))
                held.append((hashes, sizes, *own))
                size += len(hashes)
                if size >= CHUNK:
                    yield packed(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(held, number)

    fields = "chunk bigint, n_tokens bigint, ids array<bigint>, train array<boolean>, sizes array<bigint>, words binary, codes binary"
    return materialize(rows.select("id", "text", "train").mapInArrow(compute, fields), "chunks", **{"parquet.block.size": 1 << 24})


class Chunk:
    """A chunk's n-grams: of each token, with the one before it, the bigram, and with the one after it the trigram."""

    def __init__(self, words: bytes, codes: bytes, sizes: np.ndarray, train: np.ndarray):
        hashes, self.codes = np.frombuffer(words, np.uint64), np.frombuffer(codes, np.int32).astype(np.int64)
        self.sizes, self.n, self.trained = sizes, len(hashes), train
        self.hashes = np.concatenate([hashes, [START, AFTER]])
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.before = np.concatenate([[self.n], self.codes[:-1]])
        self.before[self.begin] = self.n
        self.after = np.append(self.codes[1:], self.n + 1)
        self.after[self.begin[1:] - 1] = self.n + 1
        self.train = np.repeat(train, sizes)

    def keys(self) -> np.ndarray:
        """A hash of each token's bigram."""
        return mix(mix(self.hashes)[self.before] ^ self.hashes[self.codes])

    def ngrams(self, some: np.ndarray):
        """Of the tokens ``some``: distinct bigrams and the place of each token's, distinct trigrams as (bigram, word) and the
        place of each token's."""
        width = np.int64(self.n + 2)
        pairs, pair = np.unique(self.before[some] * width + self.codes[some], return_inverse=True)
        triples, triple = np.unique(pair * width + self.after[some], return_inverse=True)
        return pairs // width, pairs % width, pair, triples // width, triples % width, triple


def _rows_of(batches):
    """Chunks and their numbers."""
    for batch in batches:
        for k in range(len(batch)):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            sizes, train = row["sizes"].values.to_numpy(), row["train"].values.to_numpy(zero_copy_only=False)
            yield row["chunk"].as_py(), Chunk(row["words"].as_py(), row["codes"].as_py(), sizes, train)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    named = [f.split() for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _bigram_questions(chunks: DataFrame, shards: int, part: int) -> DataFrame:
    """What the chunks ask the shards that belong to ``part``: hash and first word of each bigram, how many words follow it, which, and
    how often in training."""

    def compute(batches):
        for number, chunk in _rows_of(batches):
            some = np.flatnonzero(_shards(chunk.keys(), shards) % ROUNDS == part)
            first, second, _, parent, word, triple = chunk.ngrams(some)
            counts = np.bincount(triple, chunk.train[some], len(parent)).astype(np.uint32)
            keys = mix(mix(chunk.hashes)[first] ^ chunk.hashes[second])
            shard = _shards(keys, shards)
            sizes = np.bincount(parent, minlength=len(keys)).astype(np.uint32)
            order, below = np.argsort(shard, kind="stable"), np.argsort(shard[parent], kind="stable")
            firsts, words = chunk.hashes[first[order]], chunk.hashes[word[below]]
            keys, sizes, counts = keys[order], sizes[order], counts[below]
            wanted = np.unique(shard)
            a, b = (np.searchsorted(s, np.append(wanted, shards)) for s in (shard[order], shard[parent][below]))
            rows = []
            for k, s in enumerate(wanted.tolist()):
                up, down = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
                rows.append((s, number, keys[up].tobytes(), firsts[up].tobytes(), sizes[up].tobytes(), words[down].tobytes(), counts[down].tobytes()))
            yield _batch(rows, ASKED)

    return chunks.select("chunk", "sizes", "train", "words", "codes").mapInArrow(compute, ASKED)


class Shard:
    """Contexts, and the words that follow them in training, as Elias-Fano sequences; counts by place."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """One entry for each of the three; entries may repeat."""
        known, parent = np.unique(contexts, return_inverse=True)
        self.words, word = np.unique(words, return_inverse=True)
        self.width = np.int64(len(self.words) + 1)
        below, place = np.unique(parent * self.width + word, return_inverse=True)
        self.counts = np.append(np.bincount(place, counts, len(below)).astype(np.int64), 0)
        above = below // self.width
        self.totals = np.append(np.bincount(above, self.counts[:-1], len(known)).astype(np.int64), 0)
        self.types = np.append(np.bincount(above, minlength=len(known)), 0)
        self.contexts, self.below, self.keys = EliasFano.build(known), EliasFano.build(below), known

    @staticmethod
    def _find(sequence: EliasFano, x: np.ndarray) -> np.ndarray:
        if not sequence.n or not len(x):
            return np.full(len(x), -1, np.int64)
        return sequence.find(x, np.zeros(len(x), np.int64), np.full(len(x), sequence.n, np.int64))

    def __call__(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and number of different followers of each context, and count of each word below its context; 0 for what training lacks."""
        above = self._find(self.contexts, contexts)
        word = np.searchsorted(self.words, words)
        good = word < len(self.words)
        good[good] = self.words[word[good]] == words[good]
        parent = np.repeat(above, sizes)
        good &= parent >= 0
        found = np.full(len(words), -1, np.int64)
        found[good] = self._find(self.below, parent[good] * self.width + word[good])
        return self.totals[above], self.types[above], self.counts[found]


def _bigram_answers(questions: DataFrame, shards: int) -> DataFrame:
    """kind 0: counts for the chunks. kind 1: how many different words follow a first word here, for the words' shards."""

    def compute(asked: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x.as_py(), t) for x in asked.column(c)]
        keys, firsts, sizes, words, counts = read("keys", np.uint64), read("firsts", np.uint64), read("sizes", np.uint32), read("words", np.uint64), read("counts", np.uint32)
        flat, number = np.concatenate(keys), np.concatenate(counts)
        some = np.flatnonzero(number)
        parent = np.repeat(np.arange(len(flat)), np.concatenate(sizes))[some]
        shard = Shard(flat[parent], np.concatenate(words)[some], number[some])
        rows = []
        for k, source in enumerate(asked.column("source").to_pylist()):
            rows.append((source, 0, asked.column("shard")[0].as_py(), *map(_packed, shard(keys[k], sizes[k], words[k])), None, None))
        place = np.empty(len(shard.keys), np.int64)
        place[np.searchsorted(shard.keys, flat[parent])] = parent
        first, types = np.unique(np.concatenate(firsts)[place], return_counts=True)
        dest = _shards(first, shards)
        for s in np.unique(dest).tolist():
            rows.append((s, 1, 0, first[dest == s].tobytes(), types[dest == s].astype(np.uint32).tobytes(), None, None, None))
        return pa.Table.from_batches([_batch(rows, SAID)])

    return questions.groupBy("shard").applyInArrow(compute, SAID)


def _word_answers(chunks: DataFrame, followers: DataFrame, shards: int) -> DataFrame:
    """kind 2: count and followers of each chunk's words. kind 3: the shard's tokens and types of training."""

    def ask(batches):
        for number, chunk in _rows_of(batches):
            counts = np.bincount(chunk.codes, chunk.train, chunk.n + 1)
            counts[chunk.n] = chunk.trained.sum()
            words = chunk.hashes[: chunk.n + 1]
            dest = _shards(words, shards)
            order = np.argsort(dest, kind="stable")
            words, counts, wanted = words[order], counts[order].astype(np.uint32), np.unique(dest)
            ends = np.searchsorted(dest[order], np.append(wanted, shards))
            parts = [slice(ends[k], ends[k + 1]) for k in range(len(wanted))]
            yield _batch([(s, number, words[p].tobytes(), None, None, None, counts[p].tobytes()) for s, p in zip(wanted.tolist(), parts, strict=True)], ASKED)

    def answer(asked: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), np.uint64) for x in asked.column("keys")]
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in asked.column("counts")]
        sources = asked.column("source").to_pylist()
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        places = np.split(place, np.cumsum(list(map(len, words)))[:-1])
        total, followers = (np.zeros(len(known), np.int64) for _ in range(2))
        for s, p, n in zip(sources, places, counts, strict=True):
            (total if s is not None else followers)[p] += n  # distinct in each question
        rows = [(s, 2, asked.column("shard")[0].as_py(), _packed(total[p]), _packed(followers[p]), None, None, None) for s, p in zip(sources, places, strict=True) if s is not None]
        real = known != START
        rows.append((-1, 3, 0, None, None, None, int(total[real].sum()), int((total[real] > 0).sum())))
        return pa.Table.from_batches([_batch(rows, SAID)])

    none = F.lit(None).cast("binary")
    asked = chunks.select("chunk", "sizes", "train", "words", "codes").mapInArrow(ask, ASKED)
    partial = followers.select(F.col("dest").alias("shard"), F.lit(None).cast("bigint").alias("source"), F.col("first").alias("keys"), none.alias("firsts"), none.alias("sizes"), none.alias("words"), F.col("second").alias("counts"))
    return asked.unionByName(partial).groupBy("shard").applyInArrow(answer, SAID)


def _scores(chunks: DataFrame, said: DataFrame, shards: int, tokens: int, types: int) -> DataFrame:
    """The rows' scores, from their chunks and what the shards have said."""

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, train = (left.column(c).chunk(0).flatten() for c in ("ids", "train"))
        _, chunk = next(_rows_of(left.combine_chunks().to_batches()))
        data = {(k, s): (a.as_py(), b.as_py(), c.as_py()) for k, s, a, b, c in zip(right.column("kind").to_pylist(), right.column("source").to_pylist(), right.column("first"), right.column("second"), right.column("third"), strict=True)}
        words = chunk.hashes[: chunk.n + 1]
        dest = _shards(words, shards)
        order = np.argsort(dest, kind="stable")
        ends = np.searchsorted(dest[order], np.arange(shards + 1))
        count, followers = (np.zeros(chunk.n + 1, np.int64) for _ in range(2))
        for s in np.unique(dest).tolist():
            some = order[ends[s] : ends[s + 1]]
            count[some], followers[some] = (_unpacked(x, len(some)) for x in data[2, s][:2])
        first, second, pair, parent, word, triple = chunk.ngrams(np.arange(len(chunk.codes)))
        dest = _shards(mix(mix(chunk.hashes)[first] ^ chunk.hashes[second]), shards)
        order, below = np.argsort(dest, kind="stable"), np.argsort(dest[parent], kind="stable")
        a, b = (np.searchsorted(x, np.arange(shards + 1)) for x in (dest[order], dest[parent][below]))
        two, types_two, three = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(parent), np.int64)
        for s in np.unique(dest).tolist():
            some, under = order[a[s] : a[s + 1]], below[b[s] : b[s + 1]]
            answer = data[0, s]
            two[some], types_two[some], three[under] = (_unpacked(x, n) for x, n in zip(answer, (len(some), len(some), len(under)), strict=True))

        def share(n, of, kinds, lower):
            """The interpolated probability; that of the lower order where the context is unknown."""
            with np.errstate(divide="ignore", invalid="ignore"):
                found = (np.maximum(n - DISCOUNT, 0.0) + DISCOUNT * kinds * lower) / of
            return np.where(of > 0, found, lower)

        one = (count + ALPHA) / (tokens + ALPHA * (types + 1))
        p = share(two, count[first], followers[first], one[second])[pair]  # bigrams, by token
        known = triple[:-1]  # the trigram of all tokens but the first
        inside = np.ones(len(p) - 1, bool)
        inside[chunk.begin[1:] - 1] = False
        at = np.flatnonzero(inside)
        above = parent[known[at]]
        p[at + 1] = share(three[known[at]], two[above], types_two[above], p[at + 1])
        base = np.log10(one)[chunk.codes]
        add = lambda x: pa.array(np.add.reduceat(x, chunk.begin))
        columns = [ids, train, pa.array(chunk.sizes), add((count[chunk.codes] > 0).astype(np.int64)), add(base), add(np.log10(p))]
        return pa.Table.from_arrays(columns, names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    return chunks.groupBy("chunk").cogroup(said.groupBy(F.col("dest").alias("chunk"))).applyInArrow(compute, SCORES)


def score_all(rows: DataFrame, tokens_of) -> tuple[int, DataFrame]:
    """``rows``: id, text, train. Training tokens, and per row id, train, n_tokens, n_known, base_score and score. Written."""
    chunks = _chunks(rows, tokens_of)
    total = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = ROUNDS * max(1, -(-total // (SHARD * ROUNDS)))
    write = {"parquet.block.size": 1 << 24}
    parts = [materialize(_bigram_answers(_bigram_questions(chunks, shards, part), shards), "answers", **write) for part in range(ROUNDS)]
    answers = reduce(DataFrame.unionByName, parts)
    words = materialize(_word_answers(chunks, answers.where("kind = 1"), shards), "words", **write)
    tokens, types = words.where("kind = 3").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    said = answers.where("kind = 0").unionByName(words.where("kind = 2"))
    scores = materialize(_scores(chunks, said, shards, tokens, types), "scores")
    discard(chunks, words, *parts)
    return tokens, scores
