import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterlight.llm import chat_format as cf

ODD = ["\\", "\\b", "\\l\\g", "<", ">", "</turn>", "<turn:user>", "\\\\l", "a\nb", "", "é\U0001f600", cf.TRICKY]


def escaped(text):
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def brute(rows):
    """Examples per conversation: (conv_id, example) -> (text, trainable text or None)."""
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        k, formatted = 0, ""
        for place, (_, _, role, text) in enumerate(turns):
            formatted += f"<turn:{escaped(role)}>{escaped(text)}</turn>\n"
            if role == "assistant" or place == len(turns) - 1:
                k += 1
                out[conv, k] = formatted, escaped(text) if role == "assistant" else None
    return out


def rows():
    rng = random.Random(1)
    out = []
    for conv in range(25):
        for turn in range(rng.randint(1, 6)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([*ODD, None])))
    return out + [(90, 0, "assistant", "x"), (90, 0, "assistant", "x"), (91, None, "user", "late"), (91, 0, "assistant", None), (None, 1, "user", "null id"), (92, 0, "a<b>", "w " * 100_000)]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "z") for r in rows()], "conv_id bigint, turn bigint, role string, text string, example string")


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, *("".join(p) for p in zip(ODD, ODD[1:], strict=False))]], "t string")
    for r in df.select("t", cf.escape(F.col("t")).alias("e"), cf.unescape(cf.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert r.e == escaped(r.t)


def test_examples(turns):
    got = {}
    for r in cf.expand_examples(turns).collect():
        target = None if r.loss_length is None else r.text[r.loss_start : r.loss_start + r.loss_length]
        got[r.conv_id, r.example] = r.text, target
    assert got == brute(rows())


def test_read_back(turns):
    convs = {}
    for conv, turn, role, text in rows():
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    examples = brute(rows())
    for r in cf.read_back(cf.expand_examples(turns)).collect():
        own = sorted(convs[r.conv_id])
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(text) for (conv, _), (text, _) in examples.items() if conv == r.conv_id)


def test_empty_table(turns):
    assert cf.expand_examples(turns.where("false")).count() == 0
    assert cf.read_back(cf.expand_examples(turns.where("false"))).count() == 0
