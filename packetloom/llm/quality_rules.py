"""Quality rules (operator 10): text statistics, and perplexity bands of a modified Kneser-Ney model per language.

Spark counts every 4-gram of symbols of every text by language; the models are sorted hash arrays that grow with the corpus
(see kneser_ney.py), dealt out in blocks of at most `bound` 4-grams where they are large. Each language has a model of its own,
and one pooled model holds the counts of all languages together.

Each model comes in two, one for each half of the texts (by crc32 of the text, so copies stay together), and a text is scored by
those of the other half: junk would otherwise be no surprise to a model that has learned that very text.

Log perplexities (per character) are compared within language and length class. A document whose score by its language's model is
under median - below * spread is rejected: text that repeats what the model knows by heart. Clean text that changes language
scores high under one model, so for the upper side the parts of a text (PART characters) are scored each by whichever fits
it better, its language's or the pooled model; a document whose score is over median + above * spread is rejected: junk that fits
neither. Spread is the interquartile range, `floor` at least: 3.5 of them below the median are Tukey's outer fence, above it twice
that leaves room for text that changes language within a part. Classes of fewer than
`least_docs` documents take the band of the classes up to 1, 2, 4 or 8 steps of length around, or else of the whole language, or else
of all documents: the first of these that holds `least_docs`, and all documents in any case, so every document past the base rules
meets a band at every size. Means
over half the characters scatter sqrt(2) times as much, so a spread is widened by that for each step taken in, 4 at most.

Defined cases: null text has no words and fails the base rules, like every text of under 10 words; null lang is a
language of its own; repeated rows count as often as they stand; other columns may bear any name and are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .kneser_ney import GRAMS, Estimate, Model, block_of, count_grams, four_grams
from .runtime import fresh, prepare, record, release, slices, written

COUNT_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[list(b"#*$%&|<>")] = True
PART = 256
BOUND = 4 << 20  # 4-grams of one block of models: some 100 MB in each worker
POOLED = "\0all"
SUMS = pa.list_(pa.list_(pa.float64()))
_BLANK = " \t\n\x0b\x0c\r"


def halves(col: pa.Array) -> np.ndarray:
    """The half, 0 or 1, that each text belongs to."""
    return np.array([zlib.crc32(t.encode()) & 1 for t in col.to_pylist()], np.int64)


def _of_half(batch: pa.RecordBatch, lo: int, hi: int, col: pa.Array) -> list[str]:
    langs = batch.column(batch.schema.names.index("lang")).slice(lo, hi - lo).to_pylist()
    return [f"{h}{lang}" for h, lang in zip(halves(col).tolist(), langs)]


class Block:
    """A block of all models, in a worker."""

    def __init__(self, shared: tuple[dict[str, Model], int, int]):
        self.models, self.number, self.blocks = shared

    def model(self, half: int, lang: str) -> Model:
        """The one that scores texts of this half: the other half's, or if that has no such texts their own."""
        return self.models.get(f"{1 - half}{lang}") or self.models[f"{half}{lang}"]

    def part_logs(self, col: pa.Array, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text and each of its parts the sums of ln p by its language's and by the pooled model, of this block's 4-grams."""
        code, off = four_grams(col)
        groups: dict[tuple[int, str], list[int]] = {}
        for d, key in enumerate(zip(halves(col).tolist(), langs)):
            if off[d + 1] > off[d]:
                groups.setdefault(key, []).append(d)
        out = [(np.zeros(0), np.zeros(0))] * len(col)
        for (half, lang), texts in groups.items():
            used, at = np.unique(np.concatenate([code[off[d] : off[d + 1]] for d in texts]), return_inverse=True)
            n = np.array([off[d + 1] - off[d] for d in texts])
            parts = -(-n // PART)
            ends = np.cumsum(parts)
            rank = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
            edges = np.repeat(np.cumsum(n) - n, parts) + rank * PART
            here = np.flatnonzero(block_of(used, self.blocks) == self.number) if self.blocks > 1 else np.arange(len(used))
            sums = []
            for name in (lang, POOLED):
                logs = np.zeros(len(used))
                logs[here] = self.model(half, name).logs_of(used[here])
                sums.append(np.add.reduceat(logs[at], edges))
            for d, a, b in zip(texts, ends - parts, ends):
                out[d] = sums[0][a:b], sums[1][a:b]
        return out


def _finished(logs: list[tuple[np.ndarray, np.ndarray]], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log_ppl and fit_ppl of each text; NaN without characters."""
    with np.errstate(invalid="ignore"):
        return np.array([-a.sum() for a, _ in logs]) / n_chars, np.array([-np.maximum(a, b).sum() for a, b in logs]) / n_chars


def text_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a large_string array."""
    data, off = textvec.raw(col)
    starts, ends, ranges = textvec.word_spans(data, off)

    def summed(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    with np.errstate(over="ignore"):
        grams, at = textvec.shingles(textvec.span_hashes(data, starts, ends), ranges, 5)
        owner = np.repeat(np.arange(len(col), dtype=np.uint64), np.diff(at))
        keyed = textvec.mix(grams + owner * textvec._MULT[60])
    _, inverse, seen = np.unique(keyed, return_inverse=True, return_counts=True)
    again = np.flatnonzero(seen[inverse] > 1)
    first = again - at[owner[again].astype(np.int64)] + ranges[owner[again].astype(np.int64)]
    cover = np.zeros(len(starts) + 6, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[: len(starts)]) > 0)])
    dup = np.zeros(len(col), np.int64)
    for d, text in enumerate(col.to_pylist()):
        lines = [x for x in text.split("\n") if x.strip(_BLANK)] if "\n" in text else ()
        dup[d] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(ranges), "word_chars": summed((textvec.SPACE_WORDS[data] == 1) & ((data & 0xC0) != 0x80)),
        "n_symbols": summed(SYMBOL_BYTES[data]), "n_dup_lines": dup, "n_repeat_words": np.diff(covered[ranges]),
    }


def _logs_of(batch: pa.RecordBatch, at: int, lo: int, hi: int, col: pa.Array, langs: list[str], block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sums of the blocks so far (column `at`, null before the first) and of this one."""
    found = block.part_logs(col, langs)
    if block.number:
        so_far = batch.column(at).slice(lo, hi - lo).to_pylist()
        found = [(a + np.array(x), b + np.array(y)) for (a, b), (x, y) in zip(found, so_far)]
    return found


def _add(shared, text_col: str, lang_col: str, sums_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            at = batch.schema.names.index(sums_col)
            langs = batch.column(batch.schema.names.index(lang_col)).to_pylist()
            logs = [[a.tolist(), b.tolist()] for lo, hi, col in slices(batch, text_col) for a, b in _logs_of(batch, at, lo, hi, col, langs[lo:hi], block)]
            yield pa.RecordBatch.from_arrays([pa.array(logs, SUMS) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def _last_block(docs: DataFrame, models: Estimate, text_col: str, lang_col: str, sums_col: str):
    """docs with the sums of all blocks but the last in `sums_col`, and the last block, broadcast."""
    sc = docs.sparkSession.sparkContext
    docs = docs.withColumn(sums_col, F.lit(None).cast("array<array<double>>"))
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    for k in range(models.blocks - 1):
        docs = written(docs.mapInArrow(_add(sc.broadcast((models.block(k), k, models.blocks)), text_col, lang_col, sums_col), plain), "blocks")
    return docs, sc.broadcast((models.block(models.blocks - 1), models.blocks - 1, models.blocks))


SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in COUNT_NAMES), ("n_chars", pa.int64()), ("log_ppl", pa.float64()), ("fit_ppl", pa.float64())])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            names = batch.schema.names
            langs, ids = batch.column(names.index("lang")).to_pylist(), batch.column(names.index("doc_id"))
            for lo, hi, col in slices(batch, "text"):
                logs = _logs_of(batch, names.index("sums"), lo, hi, col, langs[lo:hi], block)
                n_chars = np.diff(textvec.code_points(col)[1])
                own, fit = _finished(logs, n_chars)
                rows = text_counts(col) | {"doc_id": ids.slice(lo, hi - lo), "lang": pa.array(langs[lo:hi], pa.string()), "n_chars": n_chars}
                yield record(rows | {"log_ppl": pa.array(own, pa.float64(), from_pandas=True), "fit_ppl": pa.array(fit, pa.float64(), from_pandas=True)}, SCORED)

    return run


REPEATS = "100 * n_repeat_words > 20 * n_words"


def named(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("\0null"))


def _models(docs: DataFrame, text_col: str, lang_col: str, bound: int) -> Estimate:
    prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), named(lang_col).alias("lang"))
    own = written(texts.mapInArrow(count_grams(_of_half), GRAMS).groupBy("model", "code").agg(F.sum("n").alias("n")), "counts")
    pooled = own.groupBy(F.concat(F.substring("model", 1, 1), F.lit(POOLED)).alias("model"), "code").agg(F.sum("n").alias("n"))
    models = Estimate(own.unionAll(pooled), bound)
    release(own)
    return models


def _scored(docs: DataFrame, models: Estimate, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), named(lang_col).alias("lang"))
    state, shared = _last_block(lean, models, "text", "lang", "sums")
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in SCORED)
    scored = written(state.mapInArrow(_score(shared), ddl), "scored")
    return scored.withColumn("base_failed", (F.col("n_words") < 10) | F.expr(REPEATS)).withColumn("class", F.floor(F.log2(F.col("n_chars") + 1)))


REACH = (0, 1, 2, 4, 8)  # how many length classes to each side a band may take in


def _bands(scored: DataFrame, below: float, above: float, floor: float, least_docs: int) -> DataFrame:
    """low (for log_ppl) and high (for fit_ppl) of each language and length class with documents past the base rules, from its own
    documents or the first wider group that has enough: from exact quartiles of log perplexities rounded to 1/1000, by a histogram,
    so every run finds the same."""
    scores = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.round(c, 3).alias("bin")) for c in ("log_ppl", "fit_ppl")])).alias("s")
    bins = scored.where("not base_failed and log_ppl is not null").select("lang", "class", scores).groupBy("lang", "class", "s.kind", "s.bin").agg(F.count("*").alias("m"))
    classes = bins.select("lang", "class").distinct()

    def group(level: int, lang: Column, of: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), lang.alias("of_lang"), of.cast("long").alias("of_class"))

    near = [group(k, F.col("lang"), F.col("class") + d) for k, r in enumerate(REACH) for d in range(-r, r + 1)]
    wide = [group(len(REACH), F.col("lang"), F.lit(0)), group(len(REACH) + 1, F.lit(""), F.lit(0))]
    dealt = bins.select(F.explode(F.array(*near, *wide)).alias("g"), "kind", "bin", "m").groupBy("g.level", "g.of_lang", "g.of_class", "kind", "bin").agg(F.sum("m").alias("m"))
    keys = ["level", "of_lang", "of_class", "kind"]
    whole = Window.partitionBy(*keys)
    dealt = dealt.select(*keys, "bin", F.sum("m").over(whole.orderBy("bin")).alias("upto"), F.sum("m").over(whole).alias("docs")).where((F.col("docs") >= least_docs) | (F.col("level") == len(REACH) + 1))
    quartiles = F.array(*[F.min(F.when(F.col("upto") >= p * F.col("docs"), F.col("bin"))) for p in (0.25, 0.5, 0.75)])
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(floor))
    found = dealt.groupBy(*keys).agg(quartiles.alias("q")).select(*keys[:3], F.col("kind") == "fit_ppl", F.col("q")[1], spread).toDF(*keys[:3], "fit", "mid", "spread")
    widened = F.element_at(F.array(*[F.lit(2.0 ** (min(r, 4) / 2)) for r in (*REACH, 4, 4)]), F.col("level") + 1)
    found = found.withColumn("spread", F.col("spread") * widened)
    limits = [F.max(F.when(F.col("fit") == F.lit(fit), F.col("mid") + k * F.col("spread"))).alias(name) for name, fit, k in (("low", False, -below), ("high", True, above))]
    found = found.groupBy(*keys[:3]).agg(*limits)
    own = [group(k, F.col("lang"), F.col("class")) for k in range(len(REACH))]
    wanted = classes.select("lang", "class", F.explode(F.array(*own, *wide)).alias("g")).select("lang", "class", "g.*")
    best = F.min(F.struct("level", "low", "high")).alias("b")
    return wanted.join(found, keys[:3]).groupBy("lang", "class").agg(best).select("lang", "class", "b.low", "b.high")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 3.5, above: float = 7.0, floor: float = 0.02, least_docs: int = 200, bound: int = BOUND) -> DataFrame:
    """doc_id, the counts of text_counts(), base_failed, kept, log_ppl with its limit low, and fit_ppl with its limit high, a row for each of docs."""
    scored = _scored(docs, _models(docs, text_col, lang_col, bound), id_col, text_col, lang_col)
    bands = _bands(scored, below, above, floor, least_docs)
    inside = F.coalesce((F.col("log_ppl") >= F.col("low")) & (F.col("fit_ppl") <= F.col("high")), F.lit(True))
    # a row for each language and length class, so bands are broadcast
    return scored.join(F.broadcast(bands), ["lang", "class"], "left").select("doc_id", *COUNT_NAMES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "low", "fit_ppl", "high")


def _filter(shared, bands: dict[tuple[str, int], tuple[float, float]], text_col: str, lang_col: str, sums_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            at = batch.schema.names.index(sums_col)
            langs = batch.column(batch.schema.names.index(lang_col)).to_pylist()
            keep: list[bool] = []
            for lo, hi, col in slices(batch, text_col):
                counts, n_chars = text_counts(col), np.diff(textvec.code_points(col)[1])
                own, fit = _finished(_logs_of(batch, at, lo, hi, col, langs[lo:hi], block), n_chars)
                fine = (counts["n_words"] >= 10) & (100 * counts["n_repeat_words"] <= 20 * counts["n_words"])
                for d in range(hi - lo):
                    band = bands.get((langs[lo + d], (int(n_chars[d]) + 1).bit_length() - 1))
                    keep.append(bool(fine[d]) and (band is None or bool(band[0] <= own[d] and fit[d] <= band[1])))
            if len(batch):
                yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 3.5, above: float = 7.0, floor: float = 0.02, least_docs: int = 200, bound: int = BOUND) -> DataFrame:
    """The rows of docs that quality_rules() keeps, all columns as they are. Rows are scored once more instead of joined
    with their verdicts, so no text is shuffled."""
    models = _models(docs, text_col, lang_col, bound)
    scored = _scored(docs, models, id_col, text_col, lang_col)
    bands = {(r.lang, r["class"]): (r.low, r.high) for r in _bands(scored, below, above, floor, least_docs).collect()}
    release(scored)
    lang, text, sums = fresh(docs, "lang_name", "whole_text", "part_sums")
    marked = docs.withColumns({lang: named(lang_col), text: F.col(text_col).cast("string")})
    state, shared = _last_block(marked, models, text, lang, sums)
    release(models.grams)
    return state.mapInArrow(_filter(shared, bands, text, lang, sums), T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])).drop(lang, text, sums)
