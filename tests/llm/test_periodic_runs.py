import hashlib
import random
import zlib

import numpy as np
import pytest

from meterlight.llm import periodic_runs

SPACE = " \t\n\x0b\x0c\r"


def brute_force(words):
    """All runs, by trying every start and period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(12, 2 * q) and q < best.get((start, length), n):
                best[start, length] = q
            start = end + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def expected(doc_id, text):
    words = split(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_force(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        z = periodic_runs.z_function(s)
        for i in range(len(s)):
            assert z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i)


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(0, 90):
            part = [rng.randint(0, letters - 1) for _ in range(rng.randint(1, 12))]
            words += part * rng.choice([1, 1, 2, 3, 5])
        assert periodic_runs.runs(np.array(words, np.int64)) == brute_force(words)
        assert periodic_runs.runs_of_stretch(np.array(words, np.int64)) == brute_force(words)


def test_long_texts():
    assert periodic_runs.runs(np.zeros(30000, np.int64)) == [(0, 30000, 1)]
    words = np.concatenate([np.arange(1000), np.arange(1000, 4000), np.arange(1000, 4000), np.arange(5000, 6000)])
    assert periodic_runs.runs(words) == [(1000, 6000, 3000)]


def test_rows(spark, tmp_path):
    """The whole query against brute force: nulls, empty and blank texts, repeated rows, odd spaces, other columns."""
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 20), (5, "x y z " * 9), (5, "x y z " * 9), (7, "one word"), (8, "b c\x1cd\x0be\x0c" * 30)]
    for k in range(10, 120):  # a tenth of them is changed by the contract
        words = [rng.choice(["the", "Of", "é", "q", "rr"]) for _ in range(rng.randint(1, 60))]
        rows.append((k, rng.choice(SPACE).join(words * rng.choice([1, 1, 3]))))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, words string, _h int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    short = {k for k, t in rows.items() if len(t or "") < 2500 or zlib.crc32(str(k).encode()) % 10 == 0}
    for r in periodic_runs.op13_periodic_runs(spark, folder).drop("n_words").collect():
        if r.doc_id in short:
            assert tuple(r) == expected(r.doc_id, rows[r.doc_id])


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 5)
    names = periodic_runs._Names()
    words = periodic_runs.numbered(b"  aa bbbbbbbbbb c\nc aa  ", names)
    assert [list(names)[i] for i in words] == [b"aa", b"bbbbbbbbbb", b"c", b"c", b"aa"]
