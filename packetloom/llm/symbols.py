"""Texts as arrays of small symbol classes, for character models."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

A = 48  # symbol classes: 0 boundary, 1 white space, 2-27 a-z, 28 digit, 29 other ASCII, 30-47 by hash
_HASHED = A - 30


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    symbol = np.zeros(1 << 16, np.uint8)
    letter = np.zeros(1 << 16, bool)
    for cp in range(1 << 16):
        symbol[cp], letter[cp] = _class(cp)
    return symbol, letter


def _class(cp: int) -> tuple[int, bool]:
    c = chr(cp)
    if c.isspace():
        return 1, False
    low = c.lower()[:1] or c
    if "a" <= low <= "z" and cp < 128:
        return 2 + ord(low) - 97, True
    if cp < 128:
        return (28 if c.isdigit() else 29), False
    return 30 + (ord(low) * 2654435761 >> 7) % _HASHED, c.isalpha()


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts of a large_string array, which of them are letters, and the texts' offsets in both."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = bytes(col.buffers()[2][off[0] : off[-1]]) if col.buffers()[2] else b""
    raw = np.frombuffer(data, np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    cps = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol, letter = _table()
    low = np.minimum(cps, 0xFFFF)
    out, is_letter = symbol[low], letter[low]
    for i in np.flatnonzero(cps > 0xFFFF):
        out[i], is_letter[i] = _class(int(cps[i]))
    return out, is_letter, lead[off - off[0]]
