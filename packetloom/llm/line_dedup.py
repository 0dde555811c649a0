"""Line dedup (operator 6): winnowing over line hashes, matched runs of lines, later copies deleted.

A run is a window of lines that holds `min_words` words: as few lines from a line on as do, or as few up to a line
(fewer words never count as a copy). In each run the line of least hash, among those with words, is selected as its fingerprint:
equal runs select the same line. All runs that select one place travel as one row. Fingerprints that stand at one place only are
dropped; where one has several places, its runs are compared by the hash of all their lines: of each content the first place (by
doc_id, then line) stands and the others are later copies. A passage of min_words words or more that stood before is the union of
the runs inside it: those from its lines on reach its first line, those up to its lines its last, so a match extends both ways
line by line until the texts differ. Lines in a later copy are deleted; the rest is joined as it stood.

Skew: only hashes travel; each content is reduced to its first place before it meets its copies (a partial aggregate, then an
equi-join with one row a key that Spark can split), so a line in every document costs no more than its occurrences.

Defined cases: null text has no lines and stays null; lines without words belong to runs, also at their ends; ties
(rows of one doc_id) count as the one document, so they don't delete each other; a null doc_id is never deduplicated.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import prepare, record, release, slices, written

RUNS = pa.list_(pa.struct([("run", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
PRINTS = pa.schema([("print", pa.int64()), ("doc_id", pa.int64()), ("runs", RUNS)])


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, and the text of each."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = off[owner + 1].copy()
    same = np.flatnonzero(owner[1:] == owner[:-1])
    ends[same] = starts[same + 1] - 1
    return starts, ends, owner


def least(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least value of each window first <= i < end stands, the first of equals."""
    out, at = np.zeros(len(first), np.int64), np.arange(len(values))
    level = np.frexp(end - first)[1] - 1  # of the largest power of two in the window
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        left, right = at[first[here]], at[end[here] - (1 << k)]
        out[here] = np.where(values[right] < values[left], right, left)
        left, right = at[: max(0, len(at) - (1 << k))], at[1 << k :]
        at = np.where(values[right] < values[left], right, left)
    return out


def runs(col: pa.Array, min_words: int) -> tuple[np.ndarray, ...]:
    """The runs of all texts of a large_string array, by place of their fingerprints: text, fingerprint, place (among all
    lines), content hash, first line and last line."""
    data, off = textvec.raw(col)
    if not len(data):
        return (np.zeros(0, np.int64),) * 6
    starts, ends, owner = lines_of(data, off)
    spans, _, _ = textvec.word_spans(data, off)
    words = np.searchsorted(spans, ends) - np.searchsorted(spans, starts)
    total = np.concatenate([[0], np.cumsum(words)])
    low, high = np.searchsorted(owner, owner, side="left"), np.searchsorted(owner, owner, side="right")
    many = len(starts)
    line = np.arange(many)
    on = np.searchsorted(total, total[:-1] + min_words, side="left")
    upto = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    fits, fills = on <= high, upto >= low
    first, end = np.divmod(np.unique(np.concatenate([line[fits] * (many + 1) + on[fits], upto[fills] * (many + 1) + line[fills] + 1])), many + 1)
    with np.errstate(over="ignore"):
        hashes = textvec.span_hashes(data, starts, ends)
        up, down = textvec._powers(many + 1)
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:many])])
        content = textvec.mix((acc[end] - acc[first]) * down[first] + (end - first).astype(np.uint64) * textvec._MULT[1])
    place = least(np.where(words > 0, hashes, np.uint64(0xFFFFFFFFFFFFFFFF)), first, end)
    order = np.argsort(place, kind="stable")
    first, end, place = first[order], end[order], place[order]
    return owner[place], hashes[place].view(np.int64), place, content[order].view(np.int64), first - low[place], end - 1 - low[place]


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id")).to_numpy(zero_copy_only=False)
            for lo, _, col in slices(batch, "text"):
                text, prints, place, content, first, last = runs(col, min_words)
                if not len(text):
                    continue
                heads = np.flatnonzero(np.diff(place, prepend=-1))
                parts = pa.StructArray.from_arrays([pa.array(content, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], fields=list(RUNS.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(text)), pa.int32()), parts, type=RUNS)
                yield record({"print": prints[heads], "doc_id": ids[lo + text[heads]], "runs": lists}, PRINTS)

    return run


def later_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, first, last): the runs of lines that stood before, in an earlier document or further up."""
    prepare(docs.sparkSession)
    prints = written(docs.where("doc_id is not null").mapInArrow(_runs(min_words), "print long, doc_id long, runs array<struct<run: long, first: int, last: int>>"), "prints")
    met = prints.groupBy("print").agg(F.count("*").alias("places")).where("places > 1").select("print")
    found = written(prints.join(met.hint("merge"), "print").select("print", "doc_id", F.inline("runs")), "runs")
    release(prints)
    many = found.groupBy("print", "run").agg(F.min(F.struct("doc_id", "first")).alias("origin"), F.max(F.struct("doc_id", "first")).alias("end"))
    many = many.where("origin <> end").select("print", "run", "origin")
    again = found.join(many, ["print", "run"]).where(F.struct("doc_id", "first") > F.col("origin"))
    return again.select("doc_id", "first", "last")


def _delete():
    schema = pa.schema([("doc_id", pa.int64()), ("clean_text", pa.string()), ("n_lines", pa.int64()), ("n_removed_lines", pa.int64()), ("n_removed_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids, texts, spans = (batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text", "spans"))
            rows = []
            for doc, text, cut in zip(ids, texts, spans):
                if text is None:
                    rows.append((doc, None, 0, 0, 0))
                    continue
                lines, gone, upto = text.split("\n"), [], 0
                for s in cut or ():  # in order of first lines
                    gone += range(max(upto, s["first"]), min(s["last"] + 1, len(lines)))
                    upto = max(upto, s["last"] + 1)
                out = set(gone)
                kept = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in out)
                rows.append((doc, kept, len(lines), len(gone), sum(len(lines[i].split()) for i in gone)))
            if rows:
                yield record(dict(zip(schema.names, zip(*rows))), schema)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, clean_text, n_lines, n_removed_lines and n_removed_words of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = later_runs(docs, min_words).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    joined = docs.join(spans, "doc_id", "left")
    return joined.mapInArrow(_delete(), "doc_id long, clean_text string, n_lines long, n_removed_lines long, n_removed_words long")
