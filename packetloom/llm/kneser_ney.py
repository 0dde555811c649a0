"""Modified Kneser-Ney models of four symbols, counted by Spark and kept as sorted arrays of n-gram hashes.

A symbol is a code point (white space, and the case and value of letters and digits aside), in 16 bits: those beyond the basic
plane share the places of the surrogates by hash. A 4-gram is four symbols in one long, so its suffixes and contexts are bit operations.

Spark adds up the 4-grams of each model; the lower orders are continuation counts over the distinct grams of the order above. In a
sorted hash array each seen gram has its interpolated log probability and each context its log back-off weight: the value of
any 4-gram is found by stepping down the orders. Everything that a 4-gram abcw needs (abcw, bcw, contexts abc and bc) has (b, c) in common,
bar the pairs cw. So a model of any size is dealt out in blocks by hash of (b, c), each within `bound` grams, with the pairs in every
block: values of different blocks add up, and the corpus is read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import record, release, slices, written

GRAMS = "model string, code long, n long"
HELD = 1 << 21  # grams or characters that a task holds before it adds up or sends
SALT = {kind: np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)) for i, kind in enumerate(("4", "3", "2", "1", "abc", "bc", "c"))}
_M48, _M32, _M16 = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1), np.uint64((1 << 16) - 1)


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isspace():
            out[cp] = 32
        elif c.isdecimal():
            out[cp] = 48
        elif 0xD800 <= cp < 0xE000 or cp == 0:
            out[cp] = 0xFFFF
        elif len(low := c.lower()) == 1:
            out[cp] = ord(low)
    return out


def four_grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The four symbols that end at each character as one number, with boundaries (0) before a text; the texts' offsets."""
    cps, off = textvec.code_points(col)
    s = _table()[np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps > 0xFFFF)
    s = s.astype(np.uint64)
    s[high] = 0xD800 + cps[high] * 2654435761 // 128 % 2048
    lengths = np.diff(off)
    padded = np.zeros(len(s) + 3 * len(lengths), np.uint64)
    at = np.arange(len(s)) + np.repeat(3 * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = s
    code = s
    for j in (1, 2, 3):
        code = code | padded[at - j] << np.uint64(16 * j)
    return code, off


def _added(sums: tuple[np.ndarray, np.ndarray] | None, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts, of those so far and of more codes."""
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    if sums is None:
        return code, n
    both, at = np.unique(np.concatenate([sums[0], code]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([sums[1], n]), len(both)).astype(np.int64)


def count_grams(models_of):
    """A mapInArrow function: 4-grams and their counts by model, of a task's rows (text, and what models_of reads).

    models_of(batch, lo, hi, col): the name of each text's model."""
    schema = pa.schema([("model", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def add() -> None:
            for name, codes in held.items():
                sums[name] = _added(sums.get(name), codes)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for name, (code, n) in sums.items():
                yield record({"model": pa.array([name] * len(code), pa.string()), "code": code.view(np.int64), "n": n}, schema)
            sums.clear()

        for batch in batches:
            for lo, hi, col in slices(batch, "text"):
                code, off = four_grams(col)
                for d, name in enumerate(models_of(batch, lo, hi, col)):
                    held.setdefault(name, []).append(code[off[d] : off[d + 1]])
                size += len(code)
                if size > HELD:
                    add()
                    size = 0
                    if sum(len(c) for c, _ in sums.values()) > HELD:
                        yield from out()
        add()
        yield from out()

    return run


def _discounts(ones: dict[int, int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (ones.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    cuts = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.0), float(i)) for i, x in enumerate(cuts, 1))


def _ones(counts: np.ndarray) -> dict[int, int]:
    return {i: int((counts == i).sum()) for i in (1, 2, 3, 4)}


def _order(codes: np.ndarray, counts: np.ndarray, below: np.ndarray, cuts: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order, codes sorted: the probability of each gram, given that of its suffix, and each context with its back-off weight."""
    if not len(codes):
        return np.zeros(0), codes, np.zeros(0)
    cut = np.select([counts >= 3, counts == 2], [cuts[2], cuts[1]], cuts[0])
    context = codes >> np.uint64(16)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    total, free = np.add.reduceat(counts.astype(np.float64), first), np.add.reduceat(cut, first)
    size = np.diff(np.append(first, len(codes)))
    weight = free / total
    return (counts - cut) / np.repeat(total, size) + np.repeat(weight, size) * below, context[first], weight


def _key(codes: np.ndarray, kind: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textvec.mix(codes + SALT[kind])


class Base:
    """The two lowest orders of a model, from its pairs cw and their continuation counts, and the discounts of the higher ones."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, cuts3: tuple[float, float, float], cuts4: tuple[float, float, float]):
        order = np.argsort(pairs)
        self.pairs, counts, self.cuts3, self.cuts4 = pairs[order], counts[order], cuts3, cuts4
        one, seen = np.unique(self.pairs & _M16, return_counts=True)
        p, _, free = _order(one, seen, np.full(len(one), 1 / (len(one) + 1)), _discounts(_ones(seen)))
        self.unseen = float(np.log(max(free[0] if len(free) else 1.0, 1e-12) / (len(one) + 1)))
        self.p2, context, weight = _order(self.pairs, counts, p[np.searchsorted(one, self.pairs & _M16)], _discounts(_ones(counts)))
        self.entries = [(_key(one, "1"), p), (_key(self.pairs, "2"), self.p2), (_key(context, "c"), weight)]


class Model:
    """A block of a model: one sorted array of hashes, of grams and of contexts, and their logarithms."""

    def __init__(self, base: Base, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        three, at, seen = np.unique(codes & _M48, return_inverse=True, return_counts=True)
        p3, bc, w3 = _order(three, seen, base.p2[np.searchsorted(base.pairs, three & _M32)], base.cuts3)
        p4, abc, w4 = _order(codes, counts, p3[at], base.cuts4)
        found = [*base.entries, (_key(three, "3"), p3), (_key(bc, "bc"), w3), (_key(codes, "4"), p4), (_key(abc, "abc"), w4)]
        keys, values = np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])
        order = np.argsort(keys)
        self.keys, self.logs, self.unseen = keys[order], np.log(np.maximum(values[order], 1e-12)).astype(np.float32), base.unseen

    def _find(self, codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        key = _key(codes, kind)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.logs[at]

    def logs_of(self, codes: np.ndarray) -> np.ndarray:
        """ln p(last symbol | three before) of each code of this block."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for kind, mask, context in (("4", None, "abc"), ("3", _M48, "bc"), ("2", _M32, "c"), ("1", _M16, None)):
            now = codes[open_] if mask is None else codes[open_] & mask
            seen, logs = self._find(now, kind)
            out[open_[seen]] += logs[seen]
            open_, now = open_[~seen], now[~seen]
            if context and len(open_):
                seen, logs = self._find(now >> np.uint64(16), context)
                out[open_] += np.where(seen, logs, 0.0)
        out[open_] += self.unseen
        return out


def block_of(codes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 4-gram: by its two middle symbols."""
    return (textvec.mix(codes >> np.uint64(16) & _M32) % np.uint64(blocks)).astype(np.int64)


def _dealt(blocks: int):
    schema = pa.schema([("model", pa.string()), ("code", pa.int64()), ("n", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(batch.schema.names.index(c)) for c in ("model", "code", "n")}
            yield record(cols | {"block": block_of(cols["code"].to_numpy().view(np.uint64), blocks)}, schema)

    return run


def _arrays(found: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """code and n of each model."""
    names = found["model"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    number, code, n = names.indices.to_numpy(), found["code"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(len(names.dictionary) + 1))
    return {name: (code[order[a:b]], n[order[a:b]]) for name, a, b in zip(names.dictionary.to_pylist(), cut, cut[1:])}


class Estimate:
    """The models of a table of summed 4-gram counts (model, code, n), block by block."""

    def __init__(self, grams: DataFrame, bound: int):
        grams = self.grams = written(grams, "grams")
        three = written(grams.groupBy("model", F.col("code").bitwiseAND(int(_M48)).alias("code")).agg(F.count("*").alias("n")), "trigrams")
        ones = [df.where("n < 5").groupBy("model", F.lit(k).alias("order"), "n").agg(F.count("*").alias("many")) for k, df in ((3, three), (4, grams))]
        tops: dict[tuple[str, int], dict[int, int]] = {}
        for r in ones[0].unionAll(ones[1]).collect():  # eight numbers a model
            tops.setdefault((r.model, r.order), {})[r.n] = r.many
        # what the driver holds whole: the pairs of symbols of each model, far fewer than its 4-grams
        pairs = _arrays(three.groupBy("model", F.col("code").bitwiseAND(int(_M32)).alias("code")).agg(F.count("*").alias("n")).toArrow())
        self.bases = {m: Base(*two, *(_discounts(tops.get((m, k), {})) for k in (3, 4))) for m, two in pairs.items()}
        self.blocks = max(1, -(-grams.count() // bound))
        release(three)

    def block(self, k: int) -> dict[str, Model]:
        mine = self.grams if self.blocks == 1 else self.grams.mapInArrow(_dealt(self.blocks), GRAMS + ", block long").where(F.col("block") == k)
        found = _arrays(mine.select("model", "code", "n").toArrow())
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return {m: Model(base, *found.get(m, none)) for m, base in self.bases.items()}
