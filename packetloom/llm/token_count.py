"""Token counts (operator 3) by heap-and-linked-list byte-pair merging.

The tokenizer's file gives the merges in order of rank. A word's symbols form a linked list; a heap holds its adjacent pairs by rank and
place. The lowest pair is popped and merged, its neighbours' new pairs are pushed, stale entries are skipped. The count is
the number of initial symbols less the merges; no identifiers are made. Words are cached per worker (`CACHE` at most).

The file's own steps are kept: special strings in a text count one token each, then NFC, lower case by
character, and splitting into contractions, runs of letters, single digits and runs of anything else but white space.

Defined cases: a null or blank text has no tokens; a text's length has no bound (a merge costs log time). Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, record, slices

CACHE = 1 << 20
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_WHITE = r"\t-\r \x85\xa0  -     　"
_UNICODE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _WHITE + r"\p{L}\p{N}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Merger:
    def __init__(self, model: dict, special: list[str]):
        self.ranks: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((a, b), i)
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.bytes = byte_chars()
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word: initial symbols less merges."""
        found = self.cache.get(word)
        if found is None:
            found = self._merge(word)
            if len(word) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def _merge(self, word: str) -> int:
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.end
        symbols = [s for s in symbols if s in self.vocab]
        n = len(symbols)
        if n < 2:
            return n
        ranks, left, right = self.ranks, list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, j = heapq.heappop(heap)
            if symbols[i] is None or right[i] != j or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = left[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, i))
        return n - merges

    def text(self, text: str) -> int:
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if text.isascii():
            words = _ASCII.findall(text.lower())
        else:
            words = _UNICODE.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        get, word, total = self.cache.get, self.word, 0
        for w in words:
            total += get(w) or word(w)
        return total


@lru_cache(2)
def load(content: str) -> Merger:
    whole = json.loads(content)
    return Merger(whole["model"], [x["content"] for x in whole["added_tokens"] if x["special"]])


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        merger = load(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            for lo, hi, col in slices(batch, "text"):
                off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
                yield record({"doc_id": ids.slice(lo, hi - lo), "n_bytes": np.diff(off), "n_tokens": [merger.text(x) for x in col.to_pylist()]}, schema)

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row; tokenizer: path of a tokenizers .json file on the driver (sent to the workers)."""
    prepare(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run(shared), "doc_id long, n_bytes long, n_tokens long")
