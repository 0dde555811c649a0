"""Quality classifier (operator 8): supervised subword embeddings, in the manner of fastText.

A text's features are its words, its word pairs and the 3- and 4-grams of characters (code points) within its words,
hashed into `1 << BITS` buckets. Each bucket has a learned
vector; a text is the average of its features' vectors, and a softmax layer gives the label. Vectors and layer are
trained on the driver by stochastic gradient descent in numpy, one text a step, with classes weighed to equal parts
(few lessons are gone through more often, for `least_steps` steps); a score is a chance, so the labels' odds are added back.

Training takes at most `max_rows` labelled rows (those of least seeded hash), a documented bound; what the driver gets
is their distinct features, at most `1 << BITS` a text. Scoring covers every row: the softmax of an average of
vectors needs of each feature only its vector's product with the layer, one number, so that table is broadcast (0.5 MB).

Defined cases: null or blank texts have no features and score by the layer's bias alone; labels that are null or for unknown ids
teach nothing; a doc_id with several texts or labels gives a lesson for each pair; with no lessons, or of one class only, all texts score that class's share
(0.5 without lessons). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import prepare, record, slices

BITS = 17
DIM = 12


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts of a large_string array, and their text numbers (not in order)."""
    cps, off = textvec.code_points(col)
    upper = (cps >= 65) & (cps <= 90)
    cps = np.where(upper, cps + 32, cps).astype(np.uint64)
    inside = ~((cps == 32) | (cps >= 9) & (cps <= 13))
    cut = np.zeros(len(cps) + 1, bool)
    cut[off] = True
    begins = inside & (np.append(True, ~inside[:-1])[: len(cps)] | cut[:-1])
    ends_ = inside & (np.append(~inside[1:], True)[: len(cps)] | cut[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_) + 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    owner = (np.searchsorted(off, starts, side="right") - 1).astype(np.int32)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        words = textvec.unit_hashes(cps, starts, ends)
        out, who = [(words >> shift).astype(np.int32)], [owner]
        pairs = textvec.mix(words[:-1] * textvec._MULT[30] + words[1:]) >> shift
        near = owner[:-1] == owner[1:]
        out.append(pairs[near].astype(np.int32))
        who.append(owner[:-1][near])
        lengths = ends - starts
        of_char = np.repeat(owner, lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        room = np.repeat(lengths, lengths) - place
        unit = textvec.mix(cps[inside] + textvec._MULT[31])
        gram = unit * textvec._MULT[20]
        for n in (1, 2, 3):
            gram = gram[:-1] + unit[n:] * textvec._MULT[20 + n] if len(unit) > n else gram[:0]
            if n > 1:
                fits = room[: len(gram)] > n
                out.append((textvec.mix(gram[fits] + np.uint64(n)) >> shift).astype(np.int32))
                who.append(of_char[: len(gram)][fits])
    return np.concatenate(out), np.concatenate(who)


def _lessons():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("used", pa.binary()), ("share", pa.binary())])
        for batch in batches:
            labels = batch.column(batch.schema.names.index("label")).to_pylist()
            for lo, hi, col in slices(batch, "text"):
                found, who = features(col)
                order = np.argsort(who, kind="stable")
                found, cut = found[order], np.searchsorted(who[order], np.arange(hi - lo + 1))
                used, share = [], []
                for d in range(hi - lo):
                    own = found[cut[d] : cut[d + 1]]
                    u, n = np.unique(own, return_counts=True)
                    used.append(u.astype(np.int32).tobytes())
                    share.append((n / max(1, len(own))).astype(np.float32).tobytes())
                yield record({"label": labels[lo:hi], "used": used, "share": share}, schema)

    return run


def train(lessons: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int, least_steps: int = 24_000) -> tuple[np.ndarray, float]:
    """For each bucket the product of its vector with the layer (label 1 less label 0), and the bias; by SGD on the softmax loss."""
    labels = np.array([x[0] for x in lessons], np.int64)
    ones = labels.mean() if len(labels) else 0.5
    if not len(labels) or ones in (0.0, 1.0):
        p = min(max(float(ones), 0.01), 0.99)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weigh = np.array([0.5 / (1 - ones), 0.5 / ones])
    epochs = max(epochs, -(-least_steps // len(lessons)))
    steps, done = epochs * len(lessons), 0
    for _ in range(epochs):
        for i in rng.permutation(len(lessons)):
            label, used, share = lessons[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(used):
                continue
            hidden = share @ vectors[used]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= lr * weigh[label]
            down = p @ layer
            layer -= np.outer(p, hidden)
            bias -= p
            vectors[used] -= np.outer(share, down)
    # the classes weighed the same so far: their odds among the lessons come back in
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0] + np.log(ones / (1 - ones)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        table, bias = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            for lo, hi, col in slices(batch, "text"):
                found, who = features(col)
                n = np.bincount(who, minlength=hi - lo)
                z = np.bincount(who, weights=table[found], minlength=hi - lo) / np.maximum(n, 1) + bias
                yield record({"doc_id": ids.slice(lo, hi - lo), "score": 1 / (1 + np.exp(-np.clip(z, -50, 50)))}, schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000, epochs: int = 8, rate: float = 0.3, seed: int = 5) -> DataFrame:
    """doc_id and score (the chance of label 1) of each row; labels are learned only from rows of `labels` where `learn` holds."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = labels.where(learn).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "label").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_lessons(), "label int, used binary, share binary").toPandas()
    lessons = sorted(((r.label, np.frombuffer(r.used, np.int32), np.frombuffer(r.share, np.float32)) for r in rows.itertuples()), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    shared = spark.sparkContext.broadcast(train(lessons, epochs, rate, seed))
    return texts.mapInArrow(_score(shared), "doc_id long, score double")
