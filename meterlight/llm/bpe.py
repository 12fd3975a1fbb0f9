"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces of a pre-token form a linked list. Each adjacent pair whose bytes are a token waits in the
bucket of that token's rank, by its position. A two-level bitmap marks the ranks whose bucket is not
empty; find-first-set on both levels gives the next rank, the bucket its leftmost position. An entry
whose pair has changed since it was filed is stale and skipped. Each merge files two pairs at most, so
a pre-token of n bytes takes O(n log n) steps, however long it is.

Pre-tokens repeat, so each Python worker keeps the ids of those it has met, up to a bound on their
number; beyond it the store starts anew. Documents never leave their partition: there is no shuffle.

Defined cases: a null text is empty and has no ids; special tokens are ordinary text; text that is
not valid Unicode cannot occur in Spark strings that come from UTF-8. Ids decode to bytes; decoding to
text replaces invalid UTF-8. Empty tables give no rows; other columns are kept as they are, also where
their names are those of this operator's internals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache

#: A word of the bitmap has 2 ** WORD_BITS bits; the top level has a bit for each word.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
#: Pre-tokens whose ids a worker keeps, and their greatest length in characters.
KEPT, KEPT_LENGTH = 1_000_000, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. The queue is written out in place: it is the innermost loop."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    find = ranks.get
    n = len(piece)
    after = list(range(1, n + 1))  # where the next piece starts; n at the end
    before = list(range(-1, n))
    pair = [find(piece[i : i + 2]) for i in range(n - 1)]  # rank of the pair that starts here
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank is None:
            continue
        if rank in buckets:
            buckets[rank].append(i)  # positions ascend, so the list is a heap
        else:
            buckets[rank] = [i]
            word = rank >> WORD_BITS
            words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
            top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = (word << WORD_BITS) + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heapq.heappop(bucket) if len(bucket) > 1 else bucket.pop()
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            words[word] = bits
            if not bits:
                top &= top - 1
        if pair[i] != rank:
            continue  # stale: one of its pieces has been merged meanwhile
        j = after[i]
        k = after[j]
        after[i] = k
        pair[j] = None
        pair[i] = None
        if k < n:
            before[k] = i
            changed = ((i, find(piece[i : after[k]])),)
        else:
            changed = ()
        h = before[i]
        if h >= 0:
            changed += ((h, find(piece[h:k])),)
        for at, rank in changed:
            pair[at] = rank
            if rank is None:
                continue
            if rank in buckets:
                heapq.heappush(buckets[rank], at)
            else:
                buckets[rank] = [at]
                word = rank >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
                top |= 1 << word
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return ids


class _Known(dict):
    """Pre-token to its ids as little-endian 32-bit integers; computes and keeps what is missing."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.ranks = parse_ranks(data)
        self.split = regex.compile(pattern).findall
        self.known = _Known(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _codec_maker(spark: SparkSession, path: str | None, pattern: str | None):
    """A function for the workers that gives their codec. The vocabulary is a file of fixed size, read
    on the driver and broadcast."""
    found = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or found[0], pattern or found[1]
    with open(path, "rb") as file:
        data = file.read()
    name = "bpe_" + hashlib.sha256(data + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(data)
    return lambda: worker_cache(name, lambda: Codec(shared.value, pattern))


def _ids_array(encoded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(
    docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str | None = None
) -> DataFrame:
    """``docs`` with a column ``out`` (array of ids) in place of any column of that name. ``decoded``: another such column, of the bytes
    that these ids stand for; they are decoded where they are made, so a task has one Python worker instead of a second for :func:`decode`."""
    codec = _codec_maker(docs.sparkSession, path, pattern)
    new = [out] if decoded is None else [out, decoded]
    rest = docs.drop(*new)

    def compute(batches):
        coder = codec()
        for batch in batches:
            encoded = [coder.encode(t) for t in batch.column(text_col).to_pylist()]
            more = [_ids_array(encoded)]
            if decoded is not None:
                more.append(pa.array([coder.decode(e) for e in encoded], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return rest.mapInArrow(compute, ", ".join(fields + [f"`{n}` {t}" for n, t in zip(new, ("array<int>", "binary"), strict=False)]))


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "bytes", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` with a column ``out``: the bytes that the ids stand for (null ids: empty)."""
    codec = _codec_maker(rows.sparkSession, path, pattern)
    rest = rows.drop(out)

    def compute(batches):
        coder = codec()
        for batch in batches:
            lists = batch.column(ids_col)
            flat = lists.flatten().to_numpy().astype("<u4")  # without the values of null lists
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            found = [coder.decode(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(compute, f"{fields}, `{out}` binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded, in one pass."""
    codec = _codec_maker(docs.sparkSession, path, pattern)

    def compute(batches):
        coder = codec()
        for batch in batches:
            counts, sums, back = [], [], []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py())
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
