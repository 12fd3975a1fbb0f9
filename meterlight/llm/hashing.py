"""Vectorised hashing of words and look-up in sorted hash arrays."""

from __future__ import annotations

import numpy as np

#: An odd base of the polynomial hash.
BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value *= np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(31)
    return value


def rolling(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` symbols at each place, by doubling; not linear, so independent of polynomial ones."""
    power = symbols.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)
    power ^= power >> np.uint64(32)
    found, done, size = None, 0, 1
    while True:
        if length & size:
            if found is None:
                found = power
            else:
                found = found[: len(power) - done] * np.uint64(0xD6E8FEB86659FD93) + power[done : done + len(found)]
                found ^= found >> np.uint64(29)
            done += size
        if done == length or len(power) < size:
            break
        power = power[: len(power) - size] * np.uint64(0xBF58476D1CE4E5B9) + power[size:]
        power ^= power >> np.uint64(31)
        size *= 2
    return found[: max(len(symbols) - length + 1, 0)]


def runs(offsets: np.ndarray, limit: int):
    """First and end row of runs of rows with at most ``limit`` entries (or one row), by the rows' offsets."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1, row + 1)
        yield row, end
        row = end


#: White space between words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, first: np.ndarray, end: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjacent texts (``first`` and ``end`` of each) in UTF-8, and their number in each."""
    cut = np.zeros(len(data) + 1, bool)
    cut[first[first < len(data)]] = True
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return hasher(data, starts, ends), np.diff(np.searchsorted(starts, np.append(first, end[-1:]))) if len(first) else np.zeros(0, np.int64)


def long_words(data: np.ndarray, hasher: SpanHasher, limit: int) -> np.ndarray:
    """Hashes of the words of one text, read in pieces of about ``limit`` bytes that end at white space."""
    found, start, n = [np.zeros(0, np.uint64)], 0, len(data)
    while start < n:
        end = min(start + limit, n)
        while end < n:
            space = np.flatnonzero(_SPACE[data[end : end + limit]])
            if len(space):
                end += int(space[0])
                break
            end = min(end + limit, n)
        found.append(words_of(data[start:end], np.zeros(1, np.int64), np.array([end - start]), hasher)[0])
        start = end
    return np.concatenate(found)


class SpanHasher:
    """Hashes of spans of arrays of symbols; spans with the same symbols have the same hash."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = powers(0), powers(0)

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(symbols)
        if len(self.up) < n:
            self.up, self.down = powers(2 * n, self.base), powers(2 * n, self.inverse)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class HashArray:
    """Sorted hashes with a radix index on their leading bits; rows of ``values`` belong to them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.ascontiguousarray(values[order], np.float32)
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        edges = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))
        self.starts = edges.astype(np.int32)
        self.deepest = int(np.diff(edges).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        rows = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return rows
        at = self.starts[hashes >> self.shift]
        open_ = None
        for _ in range(self.deepest):
            np.minimum(at, len(self.keys) - 1, out=at)
            hit = self.keys[at] == (hashes if open_ is None else hashes[open_])
            if open_ is None:
                rows[hit] = at[hit]
                open_ = np.flatnonzero(~hit)
                at = at[open_] + 1
            else:
                rows[open_[hit]] = at[hit]
                open_, at = open_[~hit], at[~hit] + 1
            if not len(open_):
                break
        return rows
