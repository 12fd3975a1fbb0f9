"""Elias-Fano sequences and an n-gram trie built from them; all look-ups are vectorised.

The trie's levels are arrays in one file, which a worker maps into memory. Pointers into the next level
are monotone and stored as Elias-Fano sequences. So are the word ids of a level: within the children of
a node they ascend, and adding to them the last value of the preceding node's children makes the whole
level monotone. A child is found by searching for its id plus that value between the node's pointers.
Probabilities and back-off weights are 8-bit indices into a codebook per level.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile

import numpy as np

ONE = np.uint64(1)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with ``rank`` set bits below it."""
    at = np.zeros(len(words), np.uint64)
    rank = rank.copy()
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count((words >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
        go = count <= rank
        rank -= np.where(go, count, 0)
        at += np.where(go, np.uint64(width), np.uint64(0))
    return at.astype(np.int64)


class EliasFano:
    """A sequence of integers that does not descend."""

    FIELDS = ("low", "high", "ones")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(top // max(n, 1)).bit_length() - 1) if top > n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            place = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones_at = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(((top >> bits) + n) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, (ones_at >> np.uint64(6)).astype(np.int64), ONE << (ones_at & np.uint64(63)))
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _up_to(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most ``h`` (-1 and more)."""
        k = np.maximum(h, 0)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if not hasattr(self, "_zeros") else self._zeros
        self._zeros = zeros
        word = np.minimum(np.searchsorted(zeros, k, "right") - 1, len(self.high) - 1)
        at = word * 64 + _select_in_word(~self.high[word], k - zeros[word])
        return np.where(h < 0, 0, np.minimum(at - k, self.n))

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each ``x`` between ``first`` and ``end`` (not included), or -1."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        known = h <= (len(self.high) * 64 - self.n)
        h = np.where(known, h, 0)
        a, b = np.maximum(self._up_to(h - 1), first), np.minimum(self._up_to(h), end)
        stop = b.copy()
        wanted = x & np.uint64((1 << self.bits) - 1)
        while True:
            open_ = a < b
            if not open_.any():
                break
            middle = (a + b) >> 1
            less = self._low(np.minimum(middle, max(self.n - 1, 0))) < wanted
            a = np.where(open_ & less, middle + 1, a)
            b = np.where(open_ & ~less, middle, b)
        inside = known & (a < stop)
        hit = inside.copy()
        hit[inside] = self._low(a[inside]) == wanted[inside]
        return np.where(hit, a, -1)


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the codebook: the mean of the values in each of 256 equally wide bins."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    least, width = values.min(), max(np.ptp(values) / 255.999, 1e-12)
    codes = ((values - least) / width).astype(np.uint8)
    return codes, np.bincount(codes, values, 256) / np.maximum(np.bincount(codes, minlength=256), 1)


class Trie:
    """Levels of word ids with a probability and, but for the last, a back-off weight for each entry.

    Level 1 has an entry for every id. Deeper levels hold the n-grams of their order, sorted."""

    @staticmethod
    def pack(levels: list[tuple[np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray | None]]) -> bytes:
        """``levels``: (parent place in the level above, word id, log-probability, log back-off weight),
        sorted by parent and id; parent and id are None on level 1."""
        arrays: list[np.ndarray] = []
        meta = []

        def put(array: np.ndarray) -> int:
            arrays.append(np.ascontiguousarray(array))
            return len(arrays) - 1

        def put_sequence(values: np.ndarray) -> tuple:
            sequence = EliasFano.build(values)
            return sequence.n, sequence.bits, [put(getattr(sequence, f)) for f in EliasFano.FIELDS]

        above = 0
        for parent, word, prob, weight in levels:
            level: dict = {"n": len(prob)}
            if parent is not None:
                pointers = np.searchsorted(parent, np.arange(above + 1))
                sizes = np.diff(pointers)
                last = np.where(sizes > 0, word[np.maximum(pointers[1:] - 1, 0)] if len(word) else 0, 0).astype(np.uint64)
                before = np.concatenate([[np.uint64(0)], np.cumsum(np.where(sizes > 0, last + ONE, np.uint64(0)), dtype=np.uint64)])
                level["pointers"] = put_sequence(pointers)
                level["words"] = put_sequence(before[parent] + word.astype(np.uint64))
            codes, book = quantise(prob)
            level["prob"], level["prob_book"] = put(codes), put(book)
            if weight is not None:
                codes, book = quantise(weight)
                level["weight"], level["weight_book"] = put(codes), put(book)
            meta.append(level)
            above = len(prob)
        places, at = [], 0
        for a in arrays:
            places.append((at, a.dtype.str, len(a)))
            at += -(-a.nbytes // 8) * 8
        head = pickle.dumps((meta, places))
        body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
        return len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 8) + body

    def __init__(self, data: bytes):
        """Map packed levels into memory, from a file without a name that goes with the mapping."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self.map[:8], "little")
        meta, places = pickle.loads(self.map[8 : 8 + size])
        start = 8 + size + (-(8 + size) % 8)
        arrays = [np.frombuffer(self.map, dtype, n, start + at) for at, dtype, n in places]
        self.levels = []
        for level in meta:
            found = {k: arrays[v] if isinstance(v, int) and k != "n" else v for k, v in level.items()}
            for name in ("pointers", "words"):
                if name in found:
                    n, bits, parts = found[name]
                    found[name] = EliasFano(n, bits, *(arrays[p] for p in parts))
            self.levels.append(found)

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place on ``level`` of each ``word`` below the entry ``parent`` of the level above, or -1."""
        here = self.levels[level]
        if not here["n"] or not len(parent):
            return np.full(len(parent), -1, np.int64)
        first = here["pointers"].access(parent).astype(np.int64)
        end = here["pointers"].access(parent + 1).astype(np.int64)
        found = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(end > first)
        first, end = first[some], end[some]
        # The last value before a node's children says how much was added to their ids.
        before = np.where(first > 0, here["words"].access(np.maximum(first - 1, 0)) + ONE, np.uint64(0))
        found[some] = here["words"].find(before + word[some].astype(np.uint64), first, end)
        return found

    def prob(self, level: int, place: np.ndarray) -> np.ndarray:
        here = self.levels[level]
        return here["prob_book"][here["prob"][place]]

    def weight(self, level: int, place: np.ndarray) -> np.ndarray:
        here = self.levels[level]
        return here["weight_book"][here["weight"][place]]
