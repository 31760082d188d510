"""Words and shingles of a batch of texts as numpy arrays.

A word's hash comes from prefix sums of a polynomial over its bytes (each
byte replaced by a random 64-bit value, all modulo 2**64), so a batch is
hashed without a loop over words. Everything is seeded by fixed numbers:
hashes agree between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=U64)
PLACE = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=U64) | U64(1)
LENGTH = PLACE[SHINGLE] * np.arange(SHINGLE + 1, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes (or a single longer one)."""
    group = offsets[1:] // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(offsets) - 1]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and the words per text."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    after = np.r_[inside[1:], False] & ~edge[1:]
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[LOWER[raw]] * up[:n], out=total[1:])
    words = mix((total[last] - total[first]) * down[first] + (last - first).astype(U64))
    return words, np.diff(np.searchsorted(first, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of five words, or the
    whole sequence of a shorter text; empty without words."""
    words, counts = word_hashes(raw, offsets)
    ends = np.cumsum(counts)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        runs = words[:n] * PLACE[0]
        for j in range(1, SHINGLE):
            runs += words[j:n + j] * PLACE[j]
        runs = mix(runs + LENGTH[SHINGLE])
    out = []
    for m, end in zip(counts.tolist(), ends.tolist()):
        a = end - m
        if m >= SHINGLE:
            s = np.sort(runs[a:end - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif m:
            out.append(mix(np.array([int((words[a:end] * PLACE[:m]).sum(dtype=U64))], U64) + LENGTH[m]))
        else:
            out.append(np.zeros(0, U64))
    return out
