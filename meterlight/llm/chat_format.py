r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that
reply is trainable. What follows the last assistant turn (or a conversation without one) yields one
more example without a target, so that each conversation's last example holds all its turns.

Template, one line per turn: ``<turn:ROLE>TEXT</turn>`` and a newline. Inside roles and texts
``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``; no control string can occur in
an escaped text, and :func:`unescape` restores it.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: a null text or role is empty; a null turn sorts first; rows that tie on the turn go
by role, then text; repeated rows are turns of their own; rows with a null id form one conversation;
other columns are not read. An empty table gives no example. A conversation is held as one row,
since each of its examples is one string that contains all earlier turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"


def escape(text: Column) -> Column:
    r"""Make ``\``, ``<`` and ``>`` harmless."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    r"""Undo :func:`escape`: every backslash is followed by its code, ``\b`` goes last."""
    for plain, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of ``role``, ``text`` structs."""
    whole = F.lit("<turn:([^<>]*)>([^<>]*)</turn>")
    roles, texts = (F.regexp_extract_all(formatted, whole, F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def expand_examples(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Examples of every conversation.

    Returns conv_id, example (1, 2, ...), is_last, text, loss_start, loss_length: the trainable
    reply is ``substring(text, loss_start + 1, loss_length)``, in code points; both are null where an
    example has no target.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("lines"),
        F.transform("turns", lambda t: t["role"] == F.lit(assistant)).alias("replies"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
    )
    # Positions (from 1) of the turns that end an example: every reply, and the last turn.
    ends = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == F.size("lines")) | F.element_at("replies", i))
    cut = convs.select("*", F.posexplode(ends).alias("k", "end"))
    is_reply = F.element_at("replies", F.col("end"))
    text = F.array_join(F.slice("lines", F.lit(1), F.col("end")), "")
    size = F.when(is_reply, F.element_at("sizes", F.col("end")))
    return cut.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        (F.col("end") == F.size("lines")).alias("is_last"),
        text.alias("text"),
        size.alias("loss_length"),
    ).select(
        "conv_id", "example", "is_last", "text",
        (F.length("text") - F.lit(len(CLOSE)) - F.col("loss_length")).alias("loss_start"), "loss_length",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its formatted examples."""
    target = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))
    parsed = parse_turns(F.col("text"))
    spoken = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per_example = examples.select(
        "conv_id",
        F.struct("example", F.when(F.col("loss_length").isNotNull(), target).alias("target")).alias("reply"),
        F.length("text").alias("chars"),
        F.when(F.col("is_last"), parsed).alias("parsed"),
    ).select(
        "conv_id", "reply", "chars",
        F.size("parsed").alias("n_turns"),
        F.when(F.col("parsed").isNotNull(), F.sha2(spoken, 256)).alias("turns_sha256"),
    )
    replies = F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda r: F.coalesce(r["target"], F.lit(""))), "")
    return per_example.groupBy("conv_id").agg(
        F.max("n_turns").cast("bigint").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        replies.alias("replies"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("replies").cast("bigint").alias("loss_chars"),
        F.sha2("replies", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts contain control strings of common templates.
TRICKY = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all ``conversations`` and conversation -7, then read the result back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    return read_back(expand_examples(turns.unionByName(more)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
         14 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
            + length(replace(replace(replace(body, '\', '\b'), '<', '\l'), '>', '\g')) + 1 AS chars,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM sized
)
SELECT conv_id,
       CAST(max(n) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(prefix) FILTER (WHERE role = 'assistant' OR k = n), 0) AS BIGINT) AS formatted_chars
FROM summed
GROUP BY conv_id
"""
