"""Words of whole Arrow string columns as 64-bit hashes, taken in vectorised steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Two primes below 2^31: products of two residues fit 62 bits, sums of a step's residues 64.
PRIMES = (2_147_483_647, 2_147_483_629)
SEED = 20_011


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int, p: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo p, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


class Words:
    """Hashes of the words of many texts at once.

    A word is a longest run of bytes that aren't in `gaps`; A-Z are
    lower-cased.  Its hash joins two polynomials over its bytes, modulo two
    primes and at random points fixed by a seed (the same in every task), so
    62 bits tell words apart and no pair of texts made without the seed
    collides for algebraic reasons.  Running sums over a step's bytes give the
    hashes, so no word is handled alone.
    """

    #: Bytes of text that one step takes (a longer document is a step of its own).
    STEP = 1 << 20
    #: Words of fewer bytes need no remainder a byte: 2^16 products of 47 bits fit 63.
    LONG = 1 << 16

    def __init__(self, gaps: bytes) -> None:
        rng = np.random.default_rng(SEED)
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        self.values, self.bases = [], []
        for p in PRIMES:
            values = rng.permutation(np.arange(1, 1 << 16))[:256]
            values[65:91] = values[97:123]
            self.values.append(values)
            self.bases.append(int(rng.integers(2**20, p - 1)))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def reach(self, n: int) -> None:
        if not self.tables or len(self.tables[0][0]) < n:
            n = max(n, self.STEP + 1)
            self.tables = [(powers(b, n, p), powers(pow(b, -1, p), n, p)) for b, p in zip(self.bases, PRIMES, strict=True)]

    def steps(self, column: pa.Array):
        """(word hashes, bounds) of runs of texts: text i of a run has the words bounds[i] to bounds[i + 1]."""
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + self.STEP, side="right")) - 1)
            yield self.step(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lo = hi

    def step(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self.reach(n + 1)
        gap = self.gap[data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[: max(0, n - 1)] = gap, gap[1:]
        before[at[:-1]] = True
        after[at[1:][at[1:] > 0] - 1] = True
        begin = np.flatnonzero(~gap & before[:n])
        end = np.flatnonzero(~gap & after[:n]) + 1
        long = len(end) and int((end - begin).max()) >= self.LONG
        halves = []
        for p, values, (up, down) in zip(PRIMES, self.values, self.tables, strict=True):
            parts = values[data]
            parts *= up[:n]
            if long:
                parts %= p
            sums = np.zeros(n + 1, np.int64)
            np.cumsum(parts, out=sums[1:])  # may wrap; the difference over a word is right all the same
            halves.append(((sums[end] - sums[begin]) % p * down[begin] % p).astype(np.uint64))
        return mix((halves[0] << np.uint64(31)) ^ halves[1]), np.searchsorted(begin, at)


WHITE = bytes([32, *range(9, 14)])


class Shingler:
    """Sets of word shingles of whole Arrow columns, as sorted distinct 64-bit hashes; ASCII white space parts words."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, Words(WHITE)

    def chain(self, words: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out + words[k : len(words) - n + 1 + k])
        return out

    def sets(self, column: pa.Array):
        for words, bounds in self.words.steps(column):
            full = self.chain(words, self.size) if len(words) >= self.size else words[:0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    yield words[:0]
                    continue
                s = np.sort(full[a : b - self.size + 1]) if b - a >= self.size else self.chain(words[a:b], b - a)
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
