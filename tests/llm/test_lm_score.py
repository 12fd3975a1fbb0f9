import math
import pathlib
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlight.llm import lm_score
from meterlight.llm.elias_fano import EliasFano, Trie

END, START, OTHER = "</s>", "<s>", "<other>"


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (10, 10), (1000, 50), (1000, 10**6), (3000, 10**12)])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    if n:
        places = rng.integers(0, n, 500)
        assert (EliasFano.build(values).access(places) == values[places]).all()
    values = np.unique(values)
    wanted = np.concatenate([values[:200], rng.integers(0, top + 9, 500).astype(np.uint64)])
    first, end = np.sort(rng.integers(0, len(values) + 1, (2, len(wanted))), axis=0)
    where = {int(v): i for i, v in enumerate(values)}
    expected = [p if (p := where.get(int(v), -1)) >= a and p < b else -1 for v, a, b in zip(wanted, first, end, strict=True)]
    assert EliasFano.build(values).find(wanted, first, end).tolist() == expected


def test_trie_children():
    rng = np.random.default_rng(4)
    size = 300
    two = np.unique(rng.integers(0, size * size, 4000))
    three = np.unique(rng.integers(0, len(two) * size, 3000))
    trie = Trie(Trie.pack([
        (None, None, rng.random(size), rng.random(size)),
        (two // size, two % size, rng.random(len(two)), rng.random(len(two))),
        (three // size, three % size, rng.random(len(three)), None),
    ]))
    for level, keys, above in ((1, two, size), (2, three, len(two))):
        wanted = np.concatenate([keys[::3], rng.integers(0, above * size, 3000)])
        where = {int(k): i for i, k in enumerate(keys)}
        assert trie.child(level, wanted // size, wanted % size).tolist() == [where.get(int(k), -1) for k in wanted]


def tokens(text):
    return (text or "").encode().lower().decode().split() + [END]


class Reference:
    """The same model, with dictionaries and exact probabilities."""

    def __init__(self, texts, vocabulary, grams):
        lists = [tokens(t) for t in texts]
        self.c = Counter(w for x in lists for w in x)
        self.total = sum(self.c.values())
        self.known = {w for w, n in self.c.items() if n >= vocabulary * self.total}
        self.other = self.total - sum(self.c[w] for w in self.known)
        self.other_types = len(self.c) - len(self.known)
        mapped = [[START, START, *map(self.map, x)] for x in lists]
        self.one = Counter(w for x in mapped for w in x[2:])
        self.one[START] = len(lists)
        least = grams * self.total
        self.all2 = Counter((x[i - 1], x[i]) for x in mapped for i in range(2, len(x)))
        self.two = {g: n for g, n in self.all2.items() if n >= least}
        triples = Counter(tuple(x[i - 2 : i + 1]) for x in mapped for i in range(3, len(x)))
        self.three = {g: n for g, n in triples.items() if n >= least}

    def map(self, w):
        return w if w in self.known else OTHER

    def p1(self, w):
        return (self.one[w] + 0.1) / (self.total + 0.1 * (len(self.known) + 1))

    def p2(self, v, w):
        mine = {g[1]: n for g, n in self.two.items() if g[0] == v}
        rest = 1 - sum(n - 0.75 for n in mine.values()) / self.one[v] if mine else 1
        return (mine[w] - 0.75) / self.one[v] + rest * self.p1(w) if w in mine else rest * self.p1(w)

    def p3(self, u, v, w):
        mine = {g[2]: n for g, n in self.three.items() if g[:2] == (u, v)}
        if not mine:
            return self.p2(v, w)
        rest = 1 - sum(n - 0.75 for n in mine.values()) / self.two[u, v]
        return (mine[w] - 0.75) / self.two[u, v] + rest * self.p2(v, w) if w in mine else rest * self.p2(v, w)

    def score(self, text):
        words = tokens(text)
        ids = [START, START, *map(self.map, words)]
        total = base = 0.0
        for i, w in enumerate(words):
            total += math.log10(self.p3(*ids[i : i + 3]))
            if w not in self.known:
                total += math.log10((self.c[w] + 0.1) / (self.other + 0.1 * (self.other_types + 1)))
            base += math.log10((self.c[w] + 0.1) / (self.total + 0.1 * (len(self.c) + 1)))
        return len(words), sum(w in self.c for w in words), base, total


def corpus(n=120):
    rng = random.Random(11)
    words = ["the", "of", "a", "cat", "dog", "ran", "sat", "on", "mat"]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "The CAT sat on É the mat"), (n + 3, "The CAT sat on É the mat"), (None, "a cat")]


@pytest.mark.parametrize("vocabulary,grams", [(1e-6, 2e-7), (0.01, 0.003)])
def test_against_brute_force(spark, monkeypatch, vocabulary, grams):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, hash string")
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows}
    monkeypatch.setattr(lm_score, "CHUNK", 64)
    model, counts = lm_score.train(docs.where(~lm_score.held_out("doc_id", 10, 0)), vocabulary=vocabulary, grams=grams)
    reference = Reference([t for i, t in rows if not held[i]], vocabulary, grams)
    assert (model.train_tokens, model.train_types) == (reference.total, len(reference.c))
    got = sorted(((r.id is None, r.id or 0), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_score.score(docs, model, counts).collect())
    expected = sorted(((i is None, i or 0), *reference.score(t)) for i, t in rows)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[3] == pytest.approx(e[3], abs=1e-9)
        assert g[4] == pytest.approx(e[4], abs=0.02 * g[1] + 1e-6)  # 8-bit probabilities
    assert sum(e[4] for e in expected) > sum(e[3] for e in expected)


@pytest.mark.parametrize("chunk,shard", [(1 << 20, 1 << 20), (40, 60)])
def test_every_ngram_counts(spark, monkeypatch, chunk, shard):
    """Of so many tokens that shares would cut n-grams; in one chunk and shard, and in many."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, hash string")
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows}
    for name, value in (("CHUNK", chunk), ("SHARD", shard), ("TEXTS", 64)):
        monkeypatch.setattr(lm_score.ngram_shards, name, value)
    monkeypatch.setattr(lm_score, "VOCABULARY", 0.01)
    monkeypatch.setattr(lm_score, "GRAMS", 0.003)
    model, scores = lm_score.train_and_score(docs, ~lm_score.held_out("doc_id", 10, 0))
    reference = Reference([t for i, t in rows if not held[i]], 0, 0)
    assert model.train_tokens == reference.total
    got = sorted(((r.id is None, r.id or 0), r.train, r.n_tokens, r.n_known, r.base_score, r.score) for r in scores.collect())
    expected = sorted(((i is None, i or 0), not held[i], *reference.score(t)) for i, t in rows)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[4:] == pytest.approx(e[4:], abs=1e-9)
    assert lm_score.train_and_score(docs.where("false"), F.lit(True))[1].count() == 0
    assert [r.base_score for r in lm_score.train_and_score(docs.limit(1), F.lit(False))[1].collect()] == [pytest.approx(0)]


def test_probabilities_sum_to_one():
    reference = Reference([t for _, t in corpus()], 0.01, 0.003)
    for u, v in list(reference.two)[:20]:
        assert sum(reference.p3(u, v, w) for w in [*reference.known, OTHER]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model, counts = lm_score.train(docs.where("false"))
    got = {r.id: r for r in lm_score.score(docs, model, counts).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[2].n_tokens) == (3, 0, 1)
    assert got[1].base_score == pytest.approx(0)
    assert lm_score.score(docs.where("false"), model, counts).count() == 0


FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])
from meterlight.session import build_session
from meterlight.llm import lm_score
spark = build_session("foreign", "local[2]", **{"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + sys.argv[2]})
docs = spark.createDataFrame([(i, f"the cat {i}") for i in range(30)], "doc_id bigint, text string")
model, scores = lm_score.train_and_score(docs, ~lm_score.held_out("doc_id", 10, 0))
assert scores.count() == 30
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver alone finds the repository; workers start in another folder."""
    repository = str(pathlib.Path(lm_score.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", FOREIGN, repository, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
