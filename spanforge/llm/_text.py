"""Vectorised text primitives: words, word hashes and window hashes of many documents at a time.

A block is the concatenation of whole texts as UTF-8 bytes, one space after each. Hashes are
polynomials modulo 2^64 over random byte values, taken from running sums, so a hash of any span costs
a few vector operations a byte whatever the span's length. Such polynomials lose bits on sequences like
Thue and Morse's, the more the longer they are: words of more than PLAIN_BYTES bytes are hashed one by one
by another function, and spans can be hashed modulo a prime instead (``PrimeHash``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = (~_SPACE).astype(np.int8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
END_OF_TEXT = U64(0x9E3779B97F4A7C15)
START_OF_TEXT = U64(0xD1B54A32D192ED03)


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2^64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = int(np.random.default_rng(seed + 1000).integers(1, 2**63)) * 8 + 5 & (2**64 - 1)
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            out = np.empty(size, dtype=np.uint64)
            out[0], filled, factor = 1, 1, b
            while filled < size:
                np.multiply(out[:filled], U64(factor), out=out[filled : 2 * filled])
                filled, factor = 2 * filled, factor * factor & (2**64 - 1)
            tables.append(out)
        have = tables[0], tables[1]
        if size <= 1 << 23:
            _POWERS[seed] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a xor-shift-multiply finaliser)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class SpanHash:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        power, self.inverse = powers(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = byte_values(seed)[data]
        values *= power[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        """Unmixed hash of every window of ``length`` bytes."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = self.sums[length:] - self.sums[:n]
        out *= self.inverse[:n]
        return out


_PRIME = (1 << 31) - 1
_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2^62 modulo 2^31 - 1, in place."""
    for _ in range(2):
        high = x >> U64(31)
        x &= U64(_PRIME)
        x += high
    x[x >= _PRIME] -= U64(_PRIME)
    return x


def _prime_powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _PRIME_POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = int(np.random.default_rng(seed + 2000).integers(1 << 20, _PRIME - 1))
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, _PRIME)):
            out = np.empty(size, dtype=np.uint64)
            out[0], filled, factor = 1, 1, b
            while filled < size:
                out[filled : 2 * filled] = _reduced(out[:filled] * U64(factor))
                filled, factor = 2 * filled, factor * factor % _PRIME
            tables.append(out)
        have = tables[0], tables[1]
        if size <= 1 << 23:
            _PRIME_POWERS[seed] = have
    return have[0][:n], have[1][:n]


class PrimeHash:
    """Hashes of spans of one byte array, by a polynomial modulo 2^31 - 1 with a random base: two
    different spans of m bytes collide for at most m of the bases."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        power, self.inverse = _prime_powers(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = data.astype(U64)
        values += U64(1)
        values *= power[: len(data)]
        np.cumsum(_reduced(values), out=self.sums[1:])  # below 2^31 each: no overflow below 2^33 bytes

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums[end] - self.sums[start]
        x %= U64(_PRIME)
        x *= self.inverse[start]
        return _reduced(x)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of each span, from two polynomials modulo 2^31 - 1."""
    return PrimeHash(data, 1).raw(start, end) << U64(31) | PrimeHash(data, 2).raw(start, end)


PIECE_BYTES = 1 << 20
#: Words up to this length are hashed by running sums.
PLAIN_BYTES = 32


class Words:
    """Words of a block: ``hashes`` in order, ``bounds[d]:bounds[d+1]`` being document d's."""

    def __init__(self, data: np.ndarray, lens: np.ndarray, seed: int = 1, folded: np.ndarray = LOWER, word_byte: np.ndarray = WORD_BYTE):
        offsets = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(np.asarray(lens, dtype=np.int64) + 1, out=offsets[1:])
        start, hashes, at = [np.empty(0, np.int64)], [np.empty(0, U64)], 0
        while at < len(lens):  # whole documents, about PIECE_BYTES at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
            piece = folded[data[offsets[at] : offsets[to]]]
            inside = np.zeros(len(piece) + 2, dtype=np.int8)
            inside[1:-1] = word_byte[piece]
            step = np.diff(inside)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            found = mix(SpanHash(piece, seed).raw(s, e) + (e - s).astype(U64))
            for i in np.flatnonzero(e - s > PLAIN_BYTES).tolist():
                found[i] = xxhash.xxh3_64_intdigest(piece[s[i] : e[i]], seed)
            hashes.append(found)
            start.append(s + offsets[at])
            at = to
        self.hashes, self.starts, self.offsets = np.concatenate(hashes), np.concatenate(start), offsets
        self.bounds = np.searchsorted(self.starts, offsets)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in order, and the documents' bounds in them; a document of fewer
    words, but not none, has one window of all its words."""
    h, counts = words.hashes, np.diff(words.bounds)
    m = len(h) - k + 1
    if m > 0:
        full = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            full += h[j : j + m] * U64(pow(0xA24BAED4963EE407, j + 1, 2**64))
        full = mix(full)
    else:
        full = np.empty(0, dtype=np.uint64)
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(per_doc, out=bounds[1:])
    out = np.empty(bounds[-1], dtype=np.uint64)
    long = counts >= k
    source = np.repeat(words.bounds[:-1][long] - bounds[:-1][long], per_doc[long])
    target = np.flatnonzero(np.repeat(long, per_doc))
    out[target] = full[source + target]
    for d in np.flatnonzero((counts > 0) & ~long):
        x = U64(counts[d])
        for j, v in enumerate(h[words.bounds[d] : words.bounds[d + 1]]):
            x = U64((int(x) + int(v) * pow(0xA24BAED4963EE407, j + 1, 2**64)) & (2**64 - 1))
        out[bounds[d]] = mix(np.array([x ^ START_OF_TEXT]))[0]
    return out, bounds
