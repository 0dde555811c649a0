"""Benchmark decontamination (operator 5): a broadcast hash set of test windows, scanned over training texts.

Both sides are folded (A-Z to lower case) and split into words (ASCII letters and digits, and all of
non-ASCII). A window is `size` consecutive words of a benchmark item; a shorter item is one window. Word hashes roll
into window hashes; a document window whose hash is in the sorted array of test hashes is a candidate, and its
words are compared before it counts as a hit. Documents are scanned where they lie: no shuffle at all.

The benchmark is broadcast only up to `bound` bytes of text. A larger one is dealt into blocks under that bound,
by hash of its item ids; each block is one more pass over the documents, whose hits so far ride along in columns.

Defined cases: null or wordless texts have no words and no hits; null or wordless items are ignored, a null item_id
counts as the empty string; an empty benchmark hits nothing; equal items under different ids all count, rows of
one id count once. Further columns of docs pass through and may bear any name (contamination() replaces those named like its results);
those of the benchmark are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .runtime import fresh, prepare, slices, written

BOUND = 16 << 20  # some 100 MB as arrays
COUNTS, SPANS, ITEMS = "__words", "__spans", "__items"


class Windows:
    """The test windows: arrays sorted by window hash, into one buffer of the items' words. Some 24 bytes a word besides the text."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.names = pa.array([i for i, _ in items], pa.large_string())
        data, starts, ends, ranges, words = hashed(pa.array([t for _, t in items], pa.large_string()))
        widths = ends - starts
        at = np.cumsum(widths + 1) - (widths + 1)  # words one after another, each with a blank behind it
        self.buffer = np.full(int((widths + 1).sum()), 32, np.uint8)
        self.buffer[_spans(at, widths)] = data[_spans(starts, widths)]
        counts = np.diff(ranges)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}  # length -> hash, first byte, end, item
        for length in sorted(set(np.minimum(counts, size).tolist()) - {0}):
            own = np.flatnonzero(counts == length) if length < size else np.flatnonzero(counts >= size)
            many = counts[own] - length + 1
            first = np.repeat(ranges[own], many) + _within(many)
            keys = rolled(words, length)[first]
            order = np.argsort(keys, kind="stable")
            first, item = first[order], np.repeat(own, many)[order]
            self.tables[length] = keys[order], at[first], at[first + length - 1] + widths[first + length - 1], item.astype(np.int32)

    def spelt(self, first: int, end: int) -> bytes:
        return self.buffer[first:end].tobytes()


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of counts, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _spans(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    return np.repeat(starts, widths) + _within(widths)


def hashed(col: pa.Array):
    data, off = textvec.raw(col)
    data = textvec.LOWER[data]
    starts, ends, ranges = textvec.word_spans(data, off, textvec.ALNUM_WORDS)
    with np.errstate(over="ignore"):
        return data, starts, ends, ranges, textvec.span_hashes(data, starts, ends)


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    m = len(words) - length + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(max(m, 0), np.uint64)
        for j in range(length if m > 0 else 0):
            acc += words[j : j + m] * textvec._MULT[j]
        return textvec.mix(acc)


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends))


def _scan(shared, text_col: str, found_in: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for batch in batches:
            names = batch.schema.names
            old_spans, old_items = (batch.column(names.index(c)).to_pylist() for c in found_in[1:])
            counts, spans, items = [], [], []
            for lo, hi, col in slices(batch, text_col):
                data, starts, ends, ranges, words = hashed(col)
                hits: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
                for length, (known, first, end, item) in windows.tables.items():
                    grams = rolled(words, length)
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    for i in np.flatnonzero(known[at] == grams).tolist():
                        d = int(np.searchsorted(ranges, i, side="right")) - 1
                        if i + length > ranges[d + 1]:
                            continue
                        spelt = spelling(data, starts[i : i + length], ends[i : i + length])
                        a, b = int(at[i]), int(np.searchsorted(known, grams[i], side="right"))
                        same = [k for k in range(a, b) if windows.spelt(first[k], end[k]) == spelt]
                        if same:
                            found = hits.setdefault(d, ([], set()))
                            found[0].append((i - int(ranges[d]), i - int(ranges[d]) + length))
                            found[1].update(np.unique(item[same]).tolist())
                for d in range(hi - lo):
                    counts.append(int(ranges[d + 1] - ranges[d]))
                    before, ids = old_spans[lo + d] or [], old_items[lo + d] or []
                    if d in hits:
                        spans.append(merged([*zip(before[::2], before[1::2]), *hits[d][0]]))
                        items.append(sorted({*ids, *windows.names.take(pa.array(sorted(hits[d][1]))).to_pylist()}))
                    else:
                        spans.append(before)
                        items.append(ids)
            new = dict(zip(found_in, (pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())))))
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching spans as one, flat: start, end, start, end."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, bound: int) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.select(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    many = -(-total // bound) or 1
    for k in range(many):
        block = items if many == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k)
        yield [(r.i, r.t) for r in block.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, bound: int = BOUND, names: tuple[str, str, str] = (COUNTS, SPANS, ITEMS)) -> DataFrame:
    """docs with n_words, the hit word spans (flat: start, end, ...) and the items whose windows occur, in
    columns of these `names`."""
    spark = docs.sparkSession
    prepare(spark)
    (text,) = fresh(docs, "whole_text")
    empty = (F.lit(0).cast("long"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>"))
    state = docs.withColumns({text: F.col(text_col).cast("string"), **dict(zip(names, empty))})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, bound)):
        if k:
            state = written(state, "decontaminated")
        state = state.mapInArrow(_scan(spark.sparkContext.broadcast(Windows(block, size)), text, names), schema)
    return state.drop(text)


def n_hit() -> Column:
    """The number of hit words of a row of contamination()."""
    return F.aggregate(F.transform(SPANS, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def _cut(text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            spans = batch.column(batch.schema.names.index(spans_col)).to_pylist()
            out = []
            for text, flat in zip(batch.column(at).to_pylist(), spans):
                if flat:
                    data, starts, ends, _, _ = hashed(pa.array([text], pa.large_string()))
                    whole, kept, last = text.encode(), [], 0
                    for a, b in zip(flat[::2], flat[1::2]):
                        kept.append(whole[last : starts[a]])
                        last = int(ends[b - 1])
                    text = b"".join([*kept, whole[last:]]).decode()
                out.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without the hit spans (remove="spans")."""
    names = tuple(fresh(docs, "n_words", "hit_spans", "hit_items"))
    found = contamination(docs, benchmark, text_col, names=names, **options)
    if remove == "documents":
        found = found.where(F.size(F.coalesce(names[1], F.array().cast("array<int>"))) == 0)
    elif remove == "spans":
        found = found.withColumn(text_col, F.col(text_col).cast("string"))
        found = found.mapInArrow(_cut(text_col, names[1]), T.StructType([T.StructField(f.name, f.dataType) for f in found.schema]))
    else:
        raise ValueError("remove: documents or spans")
    return found.drop(*names)
