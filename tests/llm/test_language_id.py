import math
import random

import numpy as np
import pytest

from meterlight.llm import language_id as lid

WORDS = {"aa": ["tak", "nie", "jest", "dom", "kot"], "bb": ["uno", "due", "tre", "casa", "gatto"], "cc": ["дом", "кот", "лес"]}


def texts(lang, n, rng):
    return [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(len(WORDS) * i + k, t, lang) for k, lang in enumerate(WORDS) for i, t in enumerate(texts(lang, 60, rng))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return lid.fit(docs.where("doc_id % 4 <> 2"))


def reference_log_probability(counts, text, order):
    """Interpolated Kneser-Ney, term by term."""
    levels = [dict(counts)]
    for _ in range(order - 1):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)
    levels.reverse()

    def p(gram):
        level = levels[len(gram) - 1]
        ones, twos = (sum(1 for c in level.values() if c == k) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        below = p(gram[1:]) if len(gram) > 1 else 1 / (len(levels[0]) + 1)
        followers = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        if not followers:
            return below
        total = sum(followers.values())
        return max(followers.get(gram, 0) - d, 0) / total + d * len(followers) / total * below

    padded = " " * (order - 1) + text + " "
    return sum(math.log(p(padded[i : i + order])) for i in range(len(padded) - order + 1))


def test_probabilities_are_interpolated_kneser_ney():
    rng = random.Random(5)
    counts = {}
    for lang in ("aa", "bb"):
        counts[lang] = {}
        for t in texts(lang, 20, rng):
            padded = "   " + t + " "
            for i in range(len(padded) - 3):
                g = padded[i : i + 4]
                counts[lang][g] = counts[lang].get(g, 0) + 1
    scorer = lid.Scorer(lid.kneser_ney(counts, 4))
    for text in ["tak nie", "uno gatto xyz", "q", "casa dom tre"]:
        sums, sizes, _ = scorer.totals([text])
        assert sizes[0] == len(text) + 1
        for k, lang in enumerate(scorer.languages):
            assert sums[0, k] == pytest.approx(reference_log_probability(counts[lang], text, 4), abs=1e-3)


def test_blocks_do_not_change_scores(monkeypatch, model):
    text = "tak nie jest dom " * 200
    whole = lid.Scorer(model).totals([text, "uno due"])[0]
    monkeypatch.setattr(lid, "BLOCK", 50)
    np.testing.assert_allclose(lid.Scorer(model).totals([text, "uno due"])[0], whole, rtol=1e-5)


def test_held_out_accuracy(docs, model):
    rows = lid.predict(docs.where("doc_id % 4 = 2"), model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 and not r.rejected for r in rows)


def test_odd_texts(spark, model):
    rows = [(1, None, "aa"), (2, "", None), (3, "12 !! \n", "aa"), (4, "TAK! Nie? JEST", "x"), (None, "zzz qqq www xxx vvv jjj " * 20, "x"), (6, "кот " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 6)] == ["und", "und", "und", "aa", "cc"]
    assert [got[k].rejected for k in (1, 2, 3, 4, None, 6)] == [True, True, True, False, True, False]
    assert got[1].score == 0.0


def test_nothing_to_learn_from(spark, docs):
    empty = docs.where("false")
    nothing = lid.fit(empty)
    assert {r.lang_pred for r in lid.predict(docs, nothing).collect()} == {"und"}
    assert lid.predict(empty, nothing).count() == 0


def test_a_language_whose_rows_repeat_is_learned(spark, docs):
    """Few texts of a language, each in thousands of rows."""
    few = spark.createDataFrame([(k, "kota mała piesek domek " * k, "pl") for k in (1, 2, 3)], "doc_id bigint, text string, lang string")
    repeated = few.crossJoin(spark.range(8_000)).drop("id").unionByName(docs.select("doc_id", "text", "lang"))
    once = few.unionByName(docs.select("doc_id", "text", "lang"))
    assert "pl" in lid.fit(repeated, sample=20)["languages"]
    assert lid.fit(repeated, sample=20)["languages"] == lid.fit(once, sample=20)["languages"]
