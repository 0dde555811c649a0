"""URL filters (operator 4): hand-made rules, host word segmentation, and multinomial naive Bayes.

A unigram model of words, counted by Spark over the texts of all pages, splits the labels of a host into words: Viterbi over the
positions of each label finds the split of highest probability; unknown pieces are charged by length. The words of the host and the
pieces of the path are the tokens of a url. URLs that a rule decides teach a multinomial naive Bayes model with add-one smoothing; it
decides the others.

Counts stay in written tables, whole: of the words (by 64-bit hash) only those are fetched that stand somewhere in a host at hand,
of the taught tokens only those of urls to be judged. Where that is more than `bound` rows, the urls are dealt out in blocks by
hash, as many as it takes, and each block fetches its own; every url is in one block, and no word or token is left out at any size.

Defined cases: a null url or one without :// has empty host and path, fits no rule and has no tokens, so the prior decides; rules that
tie in length can't both fit one url unless they are equal, then the first one counts; null html has no words; words and tokens may be of
any length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .runtime import prepare, record, release, text_column, written

Rule = tuple[str, str, str]  # verdict, host, path
_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^\W_]+")
HELD = 1 << 18  # counts that a task holds before it sends them


def text_of(html: str) -> str:
    """The text between tags, without scripts and styles, in time linear in the page whatever is left unclosed."""
    out, at, scan, unclosed = [], 0, 0, set()
    while m := _OPEN.search(html, scan):
        name = m[1].lower()
        end = None if name in unclosed else _CLOSE[name].search(html, m.end())
        if end is None:
            unclosed.add(name)  # nor will any later one be closed
            scan = m.end()
            if len(unclosed) == 2:
                break
            continue
        out += [html[at : m.start()], " "]
        at = scan = end.end()
    return _TAG.sub(" ", "".join([*out, html[at:]]))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text (host, path) and its verdict; null if none fits."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), verdict.otherwise(none))


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    cps, off = textvec.code_points(pa.array(words, pa.large_string()))
    return textvec.unit_hashes(cps, off[:-1], off[1:])


class Words:
    """Counts of words: a sorted array of hashes, the counts, and the lengths that any word of the corpus has."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lengths: list[int], total: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.lengths, self.total = keys[order], counts[order], lengths, max(1, total)

    def inside(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place of a known word in the names: number of the name, start, end, count."""
        found = [(np.zeros(0, np.int64),) * 4]
        if len(self.keys):
            for owner, start, end, key in windows(names, self.lengths):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                found.append((owner[hit], start[hit], end[hit], self.counts[at[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def windows(names: list[str], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the windows of the names: number of the name, start, end, hash."""
    cps, off = textvec.code_points(pa.array(names, pa.large_string()))
    owner = np.repeat(np.arange(len(names)), np.diff(off))
    left = off[owner + 1] - np.arange(len(cps))
    for n in lengths:
        start = np.flatnonzero(left >= n)
        if not len(start):
            break
        yield owner[start], start - off[owner[start]], start - off[owner[start]] + n, textvec.unit_hashes(cps, start, start + n)


class Segmenter:
    """Unigram Viterbi: the split of a name into words of the highest probability; an unknown piece costs a sum and so much a letter."""

    letter = 2.3

    def __init__(self, words: Words):
        self.words = words
        self.open = math.log(words.total * 10.0)
        self.known: dict[str, list[str]] = {}

    def learn(self, names: set[str]) -> None:
        """Split the names that have not been seen, all at once."""
        if len(self.known) > 1 << 17:
            self.known.clear()
        new = [x for x in names if x not in self.known]
        places: list[list[tuple[int, int, float]]] = [[] for _ in new]
        if new:
            for o, a, b, n in zip(*(x.tolist() for x in self.words.inside(new))):
                places[o].append((b, a, math.log(self.words.total / n)))
        for name, at in zip(new, places):
            self.known[name] = self._split(name, sorted(at))

    def split(self, name: str) -> list[str]:
        if name not in self.known:
            self.learn({name})
        return self.known[name]

    def _split(self, name: str, places: list[tuple[int, int, float]]) -> list[str]:
        best, back, k = [0.0], [0], 0
        cheapest, since = 0.0, 0  # where an unknown piece would start best: cost so far less that of the letters before
        for end in range(1, len(name) + 1):
            cost, at = cheapest + self.open + self.letter * end, since
            while k < len(places) and places[k][0] == end:
                _, start, price = places[k]
                k += 1
                if best[start] + price < cost:
                    cost, at = best[start] + price, start
            best.append(cost)
            back.append(at)
            if cost - self.letter * end < cheapest:
                cheapest, since = cost - self.letter * end, end
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        out = ["h:" + w for piece in _PIECE.findall(host) for w in self.split(piece)]
        return out + ["p:#" if piece.isdigit() else "p:" + piece for piece in _PIECE.findall(path.lower())]


def _words():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("length", pa.int32()), ("n", pa.int64())])
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = list(sums)
            rows = {"word": hashes(words).view(np.int64), "length": [len(w) for w in words], "n": list(sums.values())}
            sums.clear()
            return record(rows, schema)

        for batch in batches:
            for html in text_column(batch, "html").to_pylist():
                sums.update(w for w in _WORD.findall(text_of(html).lower()) if len(w) > 1)
                if len(sums) > HELD:
                    yield out()
        if sums:
            yield out()

    return run


def _wanted(lengths: list[int]):
    """The hashes of all windows of hosts that are as long as some word, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("word", pa.int64())])
        for batch in batches:
            hosts, blocks = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("host", "block"))
            pieces: dict[int, set[str]] = {}
            for host, block in zip(hosts, blocks):
                pieces.setdefault(block, set()).update(_PIECE.findall(host))
            for block, names in pieces.items():
                for _, _, _, key in windows(sorted(names), lengths) if names else ():
                    key = np.unique(key).view(np.int64)
                    yield record({"block": np.full(len(key), block), "word": key}, schema)

    return run


def _tokens(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("verdict", pa.string()), ("token", pa.string()), ("n", pa.int64())])
        cut = Segmenter(shared.value)
        sums: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            rows = {"verdict": [k[0] for k in sums], "token": [k[1] for k in sums], "n": list(sums.values())}
            sums.clear()
            return record(rows, schema)

        for batch in batches:
            hosts, paths, verdicts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("host", "path", "verdict"))
            cut.learn({x for h in set(hosts) for x in _PIECE.findall(h)})
            for host, path, verdict in zip(hosts, paths, verdicts):
                sums[verdict, ""] += 1  # the document count, for the prior
                sums.update((verdict, t) for t in cut.tokens(host, path))
                if len(sums) > HELD:
                    yield out()
        if sums:
            yield out()

    return run


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; alone or without lessons it says allow.

    rows: counts of the tokens at hand (verdict, token, n); docs and sums: documents and tokens of each verdict in all; seen: how many
    different tokens there are in all."""

    def __init__(self, rows: list[tuple[str, str, int]], docs: dict[str, int], sums: dict[str, int], seen: int):
        self.verdicts = sorted(docs) or ["allow"]
        total = sum(docs.values()) or 1
        self.prior = {v: math.log(docs.get(v, 1) / total) for v in self.verdicts}
        counts: dict[str, dict[str, int]] = {}
        for v, t, n in rows:
            counts.setdefault(t, {})[v] = n
        self.table = {t: [math.log((of.get(v, 0) + 1) / (sums.get(v, 0) + seen + 1)) for v in self.verdicts] for t, of in counts.items()}

    def verdict(self, tokens: list[str]) -> str:
        score = [self.prior[v] for v in self.verdicts]
        for t in tokens:
            if (row := self.table.get(t)) is not None:
                score = [a + b for a, b in zip(score, row)]
        return self.verdicts[max(range(len(score)), key=score.__getitem__)]


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
        words, bayes = shared.value
        cut = Segmenter(words)
        for batch in batches:
            cols = {c: batch.column(batch.schema.names.index(c)).to_pylist() for c in schema.names}
            cut.learn({x for h in {h for v, h in zip(cols["verdict"], cols["host"]) if v is None} for x in _PIECE.findall(h)})
            cols["verdict"] = [v or bayes.verdict(cut.tokens(h, p)) for v, h, p in zip(cols["verdict"], cols["host"], cols["path"])]
            yield record(cols, schema)

    return run


def _blocks(urls: DataFrame, needed: Callable[[DataFrame], DataFrame], bound: int) -> tuple[DataFrame, DataFrame, int]:
    """urls with a column block, the table that needed() finds for them by block (written), and the number of blocks: as many as keep
    each block's part of the table within bound."""
    many = 1
    while True:
        dealt = urls.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(many)))
        found = written(needed(dealt), "needed")
        largest = found.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if largest <= bound or many >= 1 << 20:  # a single url needs what it needs
            return dealt, found, many
        release(found)
        many *= -(-largest // bound) * 2


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bound: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    bound: rows of counts that the driver and each worker hold at once (of words; of tokens)."""
    spark = pages.sparkSession
    prepare(spark)
    words = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(_words(), "word long, length int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.first("length").alias("length"))
    words = written(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    lengths = sorted(r.length for r in words.select("length").distinct().collect())
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    def known(dealt: DataFrame) -> DataFrame:
        hosts = dealt.select("host", "block").distinct()
        return hosts.mapInArrow(_wanted(lengths), "block long, word long").distinct().join(words.hint("merge"), "word").select("block", "word", "n")

    def fetched(found: DataFrame, k: int) -> Words:
        rows = found.where(F.col("block") == k).toArrow()
        return Words(rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy(), lengths, total)

    sc = spark.sparkContext
    dealt, vocabulary, many = _blocks(urls, known, bound)
    taught = []
    for k in range(many):
        shared = sc.broadcast(fetched(vocabulary, k))
        mine = dealt.where(F.col("block") == k)
        taught.append(mine.where("verdict is not null").mapInArrow(_tokens(shared), "verdict string, token string, n long"))
    lessons = written(_union(taught).groupBy("verdict", "token").agg(F.sum("n").alias("n")), "taught")
    sums = {r.verdict: (r.docs, r.tokens) for r in lessons.groupBy("verdict").agg(F.sum(F.when(F.col("token") == "", F.col("n"))).alias("docs"), F.sum(F.when(F.col("token") != "", F.col("n"))).alias("tokens")).collect()}
    docs, tokens = {v: x[0] or 0 for v, x in sums.items()}, {v: x[1] or 0 for v, x in sums.items()}
    seen = lessons.where("token <> ''").select("token").distinct().count()

    out = [urls.where("verdict is not null")]
    for k in range(many):
        open_ = dealt.where((F.col("block") == k) & F.col("verdict").isNull())
        words_k = sc.broadcast(fetched(vocabulary, k))

        def features(of: DataFrame, words_k=words_k) -> DataFrame:
            own = of.mapInArrow(_of_block(words_k), "block long, token string").distinct()
            return own.join(lessons.hint("merge"), "token").select("block", "verdict", "token", "n")

        again, table, parts_ = _blocks(open_.drop("block"), features, bound)
        for j in range(parts_):
            rows = sorted((r.verdict, r.token, r.n) for r in table.where(F.col("block") == j).toLocalIterator())
            shared = sc.broadcast((words_k.value, Bayes(rows, docs, tokens, seen)))
            out.append(again.where(F.col("block") == j).mapInArrow(_judge(shared), "page_id long, host string, path string, rule string, verdict string"))
        release(table)
    for df in (words, vocabulary, lessons):
        release(df)
    return _union([df.select("page_id", "host", "path", "rule", "verdict") for df in out])


def _of_block(shared):
    """The different tokens of a task's urls, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("token", pa.string())])
        cut = Segmenter(shared.value)
        for batch in batches:
            hosts, paths, blocks = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("host", "path", "block"))
            cut.learn({x for h in set(hosts) for x in _PIECE.findall(h)})
            found = {(b, t) for h, p, b in zip(hosts, paths, blocks) for t in cut.tokens(h, p)}
            yield record({"block": [b for b, _ in found], "token": [t for _, t in found]}, schema)

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionAll(df)
    return out
