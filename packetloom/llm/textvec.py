"""Vectorised words, hashes and shingles over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1 << 61, 1 << 62, 64)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORDS = np.ones(256, dtype=np.uint8)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = 0
ALNUM_WORDS = np.zeros(256, dtype=np.uint8)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _pow[key] = np.cumprod(a)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a large_string array without nulls."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words. table: which bytes belong to words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = 0, inside[:-1]
    before[edge] = 0
    starts = np.flatnonzero(inside & (before ^ 1))
    before[:-1], before[-1] = inside[1:], 0
    before[edge - 1] = 0
    ends = np.flatnonzero(inside & (before ^ 1)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, alike wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    acc = np.empty(len(data) + 1, dtype=np.uint64)
    acc[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[63])


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and offsets in them of a large_string array without nulls."""
    data, off = raw(col)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[off]


def unit_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of units (code points, say), alike wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(units) + 1)
        acc = np.empty(len(units) + 1, dtype=np.uint64)
        acc[0] = 0
        np.cumsum(mix(units.astype(np.uint64) + _MULT[62]) * up[: len(units)], out=acc[1:])
        return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[61])


def shingles(words: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words of a text (of all words where there are fewer), and each text's range of them."""
    n = np.diff(ranges)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_ranges = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(out_ranges[-1], dtype=np.uint64)
    if len(words) >= k:
        m = len(words) - k + 1
        full = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            full += words[j : j + m] * _MULT[j]
        room = np.ones(len(words), dtype=bool)  # where k words of the same text begin
        last = ranges[1:][n >= k]
        for j in range(1, k):
            room[last - j] = False
        room = room[:m]
        where = np.repeat(n >= k, counts)
        out[where] = mix(full[room & np.repeat(n >= k, n)[:m]])
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = words[ranges[d] : ranges[d + 1]]
        acc = _MULT[40 + len(w)]
        for j, x in enumerate(w):
            acc = acc + x * _MULT[j]
        out[out_ranges[d]] = mix(np.array([acc], dtype=np.uint64))[0]
    return out, out_ranges


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; words are split at ASCII white space, A-Z folded."""
    data, off = raw(col)
    data = LOWER[data]
    starts, ends, ranges = word_spans(data, off)
    with np.errstate(over="ignore"):
        grams, at = shingles(span_hashes(data, starts, ends), ranges, k)
    return [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(col))]


def set_signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        x = mix(s * _MULT[50] + _MULT[51])
        total = np.add.reduce(x) * _MULT[52] ^ np.bitwise_xor.reduce(mix(x)) if len(s) else np.uint64(0)
        return int(mix(np.array([total], dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])
