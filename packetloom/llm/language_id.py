"""Language identification (operator 2) with hyperdimensional profiles.

Each letter (a code point, lower-cased) has a random vector of -1 and 1, made from its number, so letters of every script have their
own. A trigram's vector binds (multiplies) its three letters' vectors, permuted (rotated) by 2, 1 and 0 places; a blank stands for
whatever is between words, and at both ends of a text. A text's vector bundles (adds) those of its trigrams, a language's prototype those of
all its training texts; the language of highest cosine wins. Bundling is linear: each task bundles what it reads, and Spark
adds up DIM whole numbers a language, which is all that reaches the driver.

The score is the winner's share of a softmax over the cosines.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is any text where nothing was learned. Rows with null
lang teach nothing. Repeated rows teach as often as they stand; of languages with equal cosine the first by name wins. Other columns
may bear any name and are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import prepare, record, slices

DIM = 512
BLANK = 32
HELD = 1024  # languages whose bundles a task holds
TEACH = "lang string, part int, n long"
_SEED = np.uint64(0x51ED270B)


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point of the basic plane, and which of them are letters."""
    low, letter = np.arange(1 << 16, dtype=np.int64), np.zeros(1 << 16, bool)
    for cp in range(1 << 16):
        c = chr(cp)
        letter[cp] = c.isalpha()
        low[cp] = ord(c.lower()) if len(c.lower()) == 1 else cp
    return low, letter


def letter_vectors(cps: np.ndarray) -> np.ndarray:
    """A vector of -1 and 1 for each code point: the bits of DIM / 64 hashes of it."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = textvec.mix(textvec.mix(cps.astype(np.uint64) + _SEED)[:, None] + words * textvec._MULT[55])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams."""
    three = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    cps, at = np.unique(np.concatenate(three), return_inverse=True)
    table = letter_vectors(cps)
    a, b, c = np.split(at, 3)
    return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of all texts (three code points in one number), their text numbers, and which texts have a letter."""
    cps, off = textvec.code_points(col)
    low, letter = _table()
    flat = np.minimum(cps, 0xFFFF)
    s, is_letter = low[flat], letter[flat]
    for i in np.flatnonzero(cps > 0xFFFF):
        c = chr(cps[i])
        s[i], is_letter[i] = ord(c.lower()), c.isalpha()
    owner = np.repeat(np.arange(len(col)), np.diff(off))
    has = np.bincount(owner[is_letter], minlength=len(col)) > 0
    follows = np.zeros(len(s), bool)  # the first of what stands behind a letter becomes a blank, the rest goes
    follows[1:] = is_letter[:-1] & (owner[1:] == owner[:-1])
    keep = is_letter | follows
    s, owner = np.where(is_letter, s, BLANK)[keep], owner[keep]
    starts = np.searchsorted(owner, np.flatnonzero(has))
    ends = np.searchsorted(owner, np.flatnonzero(has), side="right")
    open_ = ends[s[ends - 1] != BLANK] if len(ends) else ends  # texts that end with a letter get a blank there
    at = np.concatenate([starts, open_])
    who = np.concatenate([owner[starts], owner[open_ - 1]]) if len(at) else owner[:0]
    order = np.argsort(np.concatenate([np.arange(len(s)) * 2 + 1, starts * 2, open_ * 2 - 0.5]), kind="stable") if len(at) else np.arange(len(s))
    s = np.concatenate([s, np.full(len(at), BLANK, s.dtype)])[order]
    owner = np.concatenate([owner, who])[order]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    same = owner[:-2] == owner[2:]
    return (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[same], owner[2:][same], has


def _teach():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.int64())])
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, v in sums.items():
                yield record({"lang": pa.array([lang] * DIM, pa.string()), "part": np.arange(DIM, dtype=np.int32), "n": v}, schema)
            sums.clear()

        for batch in batches:
            langs = batch.column(batch.schema.names.index("lang")).to_pylist()
            for lo, hi, col in slices(batch, "text"):
                code, owner, _ = trigrams(col)
                if not len(code):
                    continue
                names = sorted(set(langs[lo:hi]))
                number = np.array([names.index(x) for x in langs[lo:hi]])
                used, at = np.unique(code, return_inverse=True)
                counts = np.bincount(number[owner] * len(used) + at, minlength=len(names) * len(used)).reshape(len(names), len(used))
                # whole numbers under 2**24 are exact in this precision: a slice has fewer trigrams, or one long text is cut up
                table = vectors(used)
                for k, lang in enumerate(names):
                    mine = np.flatnonzero(counts[k])
                    v = counts[k][mine].astype(np.float64) @ table[mine].astype(np.float64) if counts[k].sum() >= 1 << 24 else counts[k][mine].astype(np.float32) @ table[mine]
                    sums[lang] = sums.get(lang, 0) + np.rint(v).astype(np.int64)
                if len(sums) > HELD:
                    yield from out()
        yield from out()

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        langs, prototypes = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            for lo, hi, col in slices(batch, "text"):
                code, owner, has = trigrams(col)
                pred, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if langs and len(code):
                    used, at = np.unique(code, return_inverse=True)
                    table = vectors(used)
                    for d in range(0, hi - lo, 256):  # few texts at once: their dense counts are bounded
                        e = min(d + 256, hi - lo)
                        a, b = np.searchsorted(owner, [d, e])
                        n = np.bincount((owner[a:b] - d) * len(used) + at[a:b], minlength=(e - d) * len(used)).reshape(e - d, len(used)).astype(np.float32)
                        v = n @ table
                        cos = v @ prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                        best = cos.argmax(1)
                        sure = np.exp(20.0 * (cos - cos.max(1, keepdims=True)))
                        sure = sure.max(1) / sure.sum(1)
                        for i in np.flatnonzero(has[d:e]):
                            pred[d + i], score[d + i] = langs[best[i]], float(sure[i])
                yield record({"doc_id": ids.slice(lo, hi - lo), "lang_pred": pred, "score": score}, schema)

    return run


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred and score of each row, learned from text and lang of the rows where `learn` holds."""
    spark = docs.sparkSession
    prepare(spark)
    lessons = docs.where(learn).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sums: dict[str, np.ndarray] = {}
    for r in lessons.mapInArrow(_teach(), TEACH).groupBy("lang", "part").agg(F.sum("n").alias("n")).toLocalIterator():
        sums.setdefault(r.lang, np.zeros(DIM))[r.part] = r.n
    langs = sorted(sums)
    prototypes = np.array([sums[x] / max(np.linalg.norm(sums[x]), 1e-9) for x in langs], np.float32).reshape(-1, DIM)
    shared = spark.sparkContext.broadcast((langs, prototypes))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
