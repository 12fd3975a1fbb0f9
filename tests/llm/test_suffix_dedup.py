import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from meterlight.llm import suffix_dedup as sd
from meterlight.llm.hashing import long_words, words_of


def brute(texts, length=sd.LENGTH):
    """n_bytes, n_removed, n_spans, kept_sha256 by looking at every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_difference_cover():
    differences = {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER}
    assert differences == set(range(sd.PERIOD))
    assert 3 * sd.BLOCK <= sd.LENGTH - sd.PERIOD + 1


def test_winnowing_depends_on_the_window_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 100, 700).astype(np.uint8)
    picked = []
    for before in (0, 57, 301):
        text = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), shared])
        hashes, first, last = sd.byte_anchors(text, np.zeros(1, np.int64), np.array([len(text)]))
        per_window = np.repeat(hashes, last - first + 1)
        assert len(per_window) == len(text) - sd.LENGTH + 1
        picked.append(per_window[before:].tolist())
    assert picked[0] == picked[1] == picked[2]


def test_texts_read_together_or_in_pieces_have_the_same_anchors():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (700, 12, 400, 399, 1300)]
    alone = [sd.byte_anchors(t, np.zeros(1, np.int64), np.array([len(t)])) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes, first, last = sd.byte_anchors(np.concatenate(texts), offsets[:-1], offsets[1:])
    assert hashes.tolist() == np.concatenate([a[0] for a in alone]).tolist()
    assert (last - first).tolist() == np.concatenate([a[2] - a[1] for a in alone]).tolist()
    windows = [(a, b) for _, _, a, b in sd.pieces(np.array([0, 5000]), 1000, 400)]
    assert [w[0] for w in windows] == [0, 1000, 2000, 3000, 4000] and windows[-1][1] == 5000
    assert all(b - a == 1399 for a, b in windows[:-1])


def test_long_text_has_the_words_of_the_whole():
    data = np.frombuffer(("ab  c\n" * 50 + "x" * 90 + " y z").encode(), np.uint8)
    whole, count = words_of(data, np.zeros(1, np.int64), np.array([len(data)]), sd.SpanHasher())
    assert count.tolist() == [len(whole)] == [103]
    for limit in (1, 7, 64, 1000):
        assert long_words(data, sd.SpanHasher(), limit).tolist() == whole.tolist()
    two = words_of(np.frombuffer(b"ab cdef  g", np.uint8), np.array([0, 5]), np.array([5, 10]), sd.SpanHasher())
    assert two[1].tolist() == [2, 2]


def test_rolling_hash_depends_on_the_window_alone():
    data = np.frombuffer(b"abcabcabcabcabc", np.uint8)
    for length in (1, 2, 3, 6, 7, 13):
        found = sd.rolling(data, length).tolist()
        assert len(found) == len(data) - length + 1
        strings = [bytes(data[i : i + length]) for i in range(len(found))]
        assert len(set(strings)) == len(set(found)) == len(set(zip(strings, found, strict=True)))


def collection():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(500)
    texts = [None, "", "short", prose(300), base, base]
    for cut in (399, 400, 401, 460, 531, 532, 533, 700):  # passages about the window's length
        passage = prose(200)[:cut]
        for _ in range(3):
            texts.append(prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)))
    for _ in range(12):  # near copies with edits at random places
        words = base.split(" ")
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    for _ in range(8):  # left and right parts from different places
        a, b = rng.randrange(0, 1500), rng.randrange(0, 1500)
        texts.append(base[a : a + rng.randint(150, 450)] + base[b : b + rng.randint(150, 450)])
    texts += ["a" * 1500, "a" * 399, "ab" * 700, "ab" * 700, ("é" * 150 + "x") * 6, base[:420] + prose(20) + base[:420]]
    return texts


def brute_passages(texts, words=sd.PASSAGE):
    """Words in strings of so many that another row holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = Counter(w for s in split for w in {tuple(s[i : i + words]) for i in range(len(s) - words + 1)})
    out = []
    for s in split:
        covered = set()
        for i in range(len(s) - words + 1):
            if holders[tuple(s[i : i + words])] > 1:
                covered.update(range(i, i + words))
        out.append(len(covered))
    return out


def compare(spark, tmp_path, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "null id " * 100, "x", "y"), (3, texts[3], "x", "y"), (3, texts[3], "x", "y")]
    spark.createDataFrame(rows, "doc_id bigint, text string, key string, copies string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sd.op1_suffix_dedup(spark, str(tmp_path))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in got.collect())
    found = zip(rows, brute([r[1] for r in rows]), brute_passages([r[1] for r in rows]), strict=True)
    assert got == sorted((r[0] is None, r[0] or 0, *b, p) for r, b, p in found)


@pytest.mark.parametrize("chunk", [sd.CHUNK, 40])
def test_against_brute_force(spark, chunk, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", chunk)  # with 40, most equal suffixes meet in the shuffle, else in a chunk
    compare(spark, tmp_path, collection())


def test_texts_that_share_a_hash_and_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "KEY_MASK", 15 << 4)  # 16 hashes for all texts
    monkeypatch.setattr(sd, "PIECE", 500)  # most texts are longer than a piece
    compare(spark, tmp_path, collection())


def test_passages_of_over_fifty_words(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))
    texts = [prose(100) for _ in range(4)]
    for n in (50, 51, 52, 60, 90):
        passage = prose(n)
        texts += [f"{prose(rng.randint(0, 80))} {passage} {prose(rng.randint(0, 80))}" for _ in range(4)]
        texts += [passage, f"{passage}\n{passage}"]
    texts.append(" ".join([texts[0], texts[0]]))  # only within one text and in the first
    texts.append(" ".join([prose(60)] * 3))  # within one text only
    compare(spark, tmp_path, texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sd.op1_suffix_dedup(spark, str(tmp_path)).count() == 0
