import hashlib
import random

import numpy as np
import pytest
import tiktoken

from meterlight.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.Codec(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_random_texts(codec, library):
    rng = random.Random(7)
    parts = ["a", "b", "ab", " ", "  ", "\n", "é", "\U0001f600", "\x1c", "\x85", "12", "the", "tion", ".", "'s", "\t", "　", "ß", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        assert ids(codec, text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "thning" * 1000, "é" * 3000, " " * 4000, "1" * 3000])
def test_long_pre_tokens(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)


def test_store_of_known_pre_tokens_is_bounded(monkeypatch, codec, library):
    monkeypatch.setattr(bpe, "KEPT", 3)
    fresh = bpe.Codec(open(PATH, "rb").read(), PATTERN)
    text = "zorp quax blim frobnic zorp quax"
    assert ids(fresh, text) == library.encode_ordinary(text)
    assert len(fresh.known) <= 3


def test_rows(spark, library):
    rows = [(1, "Hello worlds", "x"), (2, None, None), (3, "", ""), (3, "Hello worlds", "x"), (None, " \n", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = bpe.encode(docs, out="ids")
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(coded).collect()
    assert len(back) == 5
    for r in back:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r["bytes"]) == (r.text or "").encode()
    for r in bpe.round_trip(docs).collect():
        assert r.n_tokens >= 0 and len(r.ids_sha256) == 64
    assert bpe.round_trip(docs.where("false")).count() == 0
    empty = [r for r in bpe.round_trip(docs).collect() if r.n_tokens == 0]
    assert {r.decoded_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()}


def test_decoded_beside_the_ids(spark):
    docs = spark.createDataFrame([(1, "Größe 12,5 🙂", b"old"), (2, None, b"old"), (3, "", None)], "id bigint, text string, back binary")
    one = bpe.encode(docs, decoded="back")
    two = bpe.decode(bpe.encode(docs.drop("back")), out="back")
    assert one.columns == two.columns
    assert sorted(one.collect()) == sorted(two.collect())
