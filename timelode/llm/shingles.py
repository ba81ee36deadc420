"""Word and shingle fingerprints of many texts at once, in NumPy.

Words are runs of bytes other than ASCII white space. A word's hash is a
polynomial over a random byte table, modulo 2**64, then mixed; a shingle's
combines the hashes of its words in order. All work is on whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p)


@dataclass
class Words:
    """Word hashes of a run of texts; text i has those from first[i] to first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    buf: np.ndarray
    byte_first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str], lower: bool = False) -> Words:
    """lower: A-Z count as a-z."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        raw = [r.lower() for r in raw]  # of bytes: nothing but A-Z changes
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    byte_first = np.concatenate([[0], np.cumsum(lengths)])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64), buf, byte_first)
    spans = np.diff(np.append(starts, len(buf)))
    tail = np.arange(starts[0], len(buf)) - np.repeat(starts, spans)
    values = _BYTE[buf[starts[0] :]] * _powers(int(spans.max()))[tail]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return Words(hashes, np.searchsorted(starts, byte_first), buf, byte_first)


def windows_of(words: Words, n: int = 5) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 of a text reach
    into the next one and must not be used."""
    h = words.hashes
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return mix(out)


def shingle_sets(texts: list[str], n: int = 5, lower: bool = False) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer than n words
    has one shingle, all its words; a text without words has none."""
    words = words_of(texts, lower)
    wins = windows_of(words, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(wins[a : b - n + 1]))
        elif b > a:
            short = (words.hashes[a:b] * _PLACE[n + (b - a) : n + 2 * (b - a)]).sum(dtype=np.uint64)
            out.append(mix(np.array([short + U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_fingerprint(values: np.ndarray) -> bytes:
    """16 bytes that stand for a set of hashes (sums of two mixings, with its size)."""
    one = mix(values ^ U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = mix(values + U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return mix(np.array([one + U(len(values)), two ^ U(len(values))], np.uint64)).tobytes()


def minhash(sets: list[np.ndarray], k: int, seed: int = 1) -> np.ndarray:
    """k MinHash values (32 bits) of each non-empty set, one row a set."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factors = rng.integers(1, 2**63, k, dtype=np.uint64) * U(2) + U(1)
    flat = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), k), np.uint32)
    for j in range(k):
        out[:, j] = (np.minimum.reduceat(flat * factors[j], offsets) >> U(32)).astype(np.uint32)
    return out


def min_max_hash(sets: list[np.ndarray], k: int, seed: int = 2) -> np.ndarray:
    """2 * k values (32 bits) of each non-empty set from k hash functions: the k
    minima, then the k maxima."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factors = rng.integers(1, 2**63, k, dtype=np.uint64) * U(2) + U(1)
    flat = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * k), np.uint32)
    for j in range(k):
        hashed = flat * factors[j]
        out[:, j] = (np.minimum.reduceat(hashed, offsets) >> U(32)).astype(np.uint32)
        out[:, k + j] = (np.maximum.reduceat(hashed, offsets) >> U(32)).astype(np.uint32)
    return out
