"""Operators of packetloom.llm against brute-force versions, on small tables with awkward rows."""

import hashlib
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, queries, sharding, token_count, url_filter

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("node", T.StringType()), ("score", T.StringType()))])
BASE = " ".join(f"word{i}" for i in range(60))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    long = " ".join(f"w{i % 997}x{i}" for i in range(9000))
    texts = {
        1: None, 2: "", 3: "  \n\t ", 4: "one", 5: "One", 6: "a b c", 7: BASE, 8: BASE.upper(), 9: BASE.replace("word30", "changed"), 10: BASE + " tail",
        11: " ".join(BASE.split()[:30]), 12: long, 13: long + " end", 14: "naïve café ÀÉ 日本語 \U0001f600 text", 15: "x" * 30000, 16: "a b a b a b a b a b a b a b", 17: BASE,
    }
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", 1, "clash", "clash") for i, t in texts.items()]
    return rows + [rows[6], rows[6], (None, "a row without an id", "en", "s1", 1, "c", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """Components over rows; rows with one id are one document, each row without an id is its own."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, r) in enumerate(sets[:a]):
            if s and r and 100 * len(s & r) >= 75 * len(s | r):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def test_jaccard_null_ids(spark):
    words = [f"n{j}" for j in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(["x", *words])), (3, " ".join(words[:-1])), (2, " ".join([*words, "y"])), (None, "quite another text of no one at all"), (None, "quite another text of no one at all"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (1 << 18, 20):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, chunk=chunk).collect())
        assert got == brute_components(rows)


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_jaccard_odd(odd, chunk):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd, chunk=chunk).collect())
    assert got == brute_components([(r[0], r[1]) for r in odd_rows()])


def test_jaccard_near_group(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        w = [f"g{i % 2}t{j}" for j in range(90)]
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            w[at] = f"new{i}-{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for chunk in (1 << 18, 1500):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, chunk=chunk, frequent=50).collect())
        assert got == brute_components(rows)


@pytest.mark.parametrize("num, den", [(75, 100), (30, 100), (1, 1)])
def test_thinned(num, den):
    """Every linked pair keeps a block; blocks have their leader and no member without a partner; chance meetings go."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 1200), dtype=np.uint64)) for _ in range(80)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.12], rng.integers(0, 1 << 63, len(s) // 9, dtype=np.uint64))) for s in sets[:30] * 2]
    sets = [s for s in sets if len(s)]
    out = jaccard_join.thinned(0, [(i, len(s), jaccard_join.parities(s)) for i, s in enumerate(sets)], num, den)
    blocks = defaultdict(set)
    for block, node, n in out:
        assert n == len(sets[node])
        blocks[block].add(node)
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if den * (n := len(np.intersect1d(sets[a], sets[b]))) >= num * (len(sets[a]) + len(sets[b]) - n)}
    assert linked <= {(a, b) for nodes in blocks.values() for a in nodes for b in nodes} and all(b in nodes and len(nodes) > 1 for b, nodes in blocks.items())
    if num == 75:
        assert linked and not {i for i in range(30, 80) if len(sets[i]) > 50} & set().union(*blocks.values())


@pytest.mark.parametrize("whole", [1 << 12, 3])
def test_jaccard_chance(spark, monkeypatch, whole):
    """Texts that share a passage and no more aren't searched, except in blocks too large to be thinned."""
    rows = [(i, " ".join([f"p{i // 3}-{j}" for j in range(6)] + [f"c{i % 4}-{j}" for j in range(6)] + [f"w{i % 58}-{j}" for j in range(50)])) for i in range(60)]
    tables, write = {}, jaccard_join.written

    def spy(df, label):
        out = write(df, label)
        tables[label] = [tuple(r) for r in out.collect()] if label == "members" else None
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    monkeypatch.setattr(jaccard_join, "WHOLE", whole)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, frequent=10).collect())
    assert got == brute_components(rows)
    assert whole == 3 or len({node for _, node, _ in tables["members"]}) == 4  # 0 and 58, 1 and 59


def test_divide_skip():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40), dtype=np.uint64)) for _ in range(20)]
        index = defaultdict(list)
        for x, s in enumerate(sets):
            for t in s.tolist():
                index[t].append(x)
        q = sets[0]
        for least in (1, 5, len(q)):
            want = {x: n for x, s in enumerate(sets) if (n := len(np.intersect1d(s, q))) >= least}
            assert jaccard_join.divide_skip(q, {t: np.array(x) for t, x in index.items()}, least) == want


def brute_hits(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(fold(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w = word.findall(fold(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("bound", [1 << 20, 100])
def test_decontaminate(spark, odd, bound):
    items = [(1, BASE[:120]), (2, "a, b! c"), (10, BASE[:120]), (3, None), (4, "..."), (5, "cafÉ Àé"), (6, " ".join(BASE.split()[20:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(odd, bench, bound=bound)
    ids = F.concat_ws(",", F.array_sort(decontaminate.ITEMS))
    got = found.select("doc_id", decontaminate.COUNTS, decontaminate.n_hit(), F.size(decontaminate.ITEMS), F.sha2(ids, 256), decontaminate.n_hit() > 0)
    assert Counter(map(tuple, got.collect())) == brute_hits([(r[0], r[1]) for r in odd_rows()], items)
    clean = decontaminate.decontaminate(odd, bench, remove="spans")
    assert clean.columns == odd.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left[6].strip() == "" and left[4] == "one" and left[1] is None


@tables
def test_decontaminate_query(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert Counter(map(tuple, queries.op5_decontaminate(spark, SF).collect())) == want


@tables
def test_jaccard_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.op1_jaccard_join(spark, SF).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs])


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_counts(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *brute_counts(r[1])) for r in odd_rows())
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def symbols(text):
    out = []
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        out.append(" " if c.isspace() else "0" if c.isdecimal() else low)
    return ["^"] * 3 + out


def brute_kneser_ney(texts):
    """-ln p of each symbol of a text, by dictionaries."""
    counts = [None, None, None, None, Counter(tuple(s[i : i + 4]) for t in texts for s in [symbols(t)] for i in range(len(s) - 3))]
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, contexts = [None], [None]
    for n in (1, 2, 3, 4):
        c = Counter(counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = (1 - 2 * y * c[2] / c[1] if c[1] else 0.5, 2 - 3 * y * c[3] / c[2] if c[2] else 1.0, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5)
        cuts.append([min(max(x, 0.0), i) for i, x in enumerate(d, 1)])
        by = defaultdict(list)
        for g, k in counts[n].items():
            by[g[:-1]].append(k)
        contexts.append(by)

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        seen = contexts[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda k: cuts[n][min(k, 3) - 1] if k else 0.0
        k = counts[n][g]
        return (k - cut(k)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return lambda text: [-np.log(max(p(tuple(s[i : i + 4])), 1e-12)) for s in [symbols(text)] for i in range(len(s) - 3)]


def kn_rows():
    rng = np.random.default_rng(12)
    vocabulary = {"en": ["the", "cat", "sat", "on", "mats", "Dogs", "12"], "ru": ["кот", "спит", "на", "полу", "😀"], None: ["日本", "語", "の", "文"]}
    return [(i, " ".join(rng.choice(vocabulary[x], int(rng.integers(11, 90)))), x) for i, x in enumerate(["en", "ru", None, "en"] * 12)] + [(50, "", "en"), (51, "lone", "xx")]


@pytest.mark.parametrize("bound", [1 << 20, 100])
def test_kneser_ney_brute(spark, bound):
    rows = kn_rows()
    half = {i: zlib.crc32(t.encode()) & 1 for i, t, _ in rows}
    models = {}
    for h in (0, 1):
        for x in {x for *_, x in rows} | {"all"}:
            mine = [t for i, t, y in rows if t and half[i] == h and x in (y, "all")]
            if mine:
                models[h, x] = brute_kneser_ney(mine)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for r in quality_rules.quality_rules(df, bound=bound).collect():
        text, lang = next((t, x) for i, t, x in rows if i == r.doc_id)
        if not text:
            assert r.log_ppl is None
            continue
        own, whole = (models.get((1 - half[r.doc_id], x)) or models[half[r.doc_id], x] for x in (lang, "all"))
        a, b = own(text), whole(text)
        fit = sum(min(sum(a[k : k + 256]), sum(b[k : k + 256])) for k in range(0, len(a), 256))
        assert abs(r.log_ppl - np.mean(a)) < 1e-4 and abs(r.fit_ppl - fit / len(a)) < 1e-4
    kept = quality_rules.keep_good(df.withColumns({"whole_text": F.lit(1), "PART_SUMS": F.lit(2)}), bound=bound)
    assert kept.columns == ["doc_id", "text", "lang", "whole_text", "PART_SUMS"]
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in quality_rules.quality_rules(df, bound=bound).where("kept").collect()}


def brute_bands(rows, below=3.5, above=7.0, floor=0.02, least_docs=200):
    """low and high of each (lang, class), from rows of quality_rules past the base rules: lists of (lang, class, log_ppl, fit_ppl)."""
    out = {}
    for lang, cls in {(x[0], x[1]) for x in rows}:
        groups = [([x for x in rows if x[0] == lang and abs(x[1] - cls) <= r], r) for r in (0, 1, 2, 4, 8)] + [([x for x in rows if x[0] == lang], 4), (rows, 4)]
        mine, reach = next(((g, r) for g, r in groups if len(g) >= least_docs), groups[-1])
        limits = []
        for col, k in ((2, -below), (3, above)):
            v = sorted(float(Decimal(repr(x[col])).quantize(Decimal("0.001"), ROUND_HALF_UP)) for x in mine)
            q = [v[int(np.ceil(p * len(v))) - 1] for p in (0.25, 0.5, 0.75)]
            limits.append(q[1] + k * max(q[2] - q[0], floor) * 2 ** (min(reach, 4) / 2))
        out[lang, cls] = limits
    return out


@tables
@pytest.mark.parametrize("least", [200, 20])
def test_bands_brute(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r.doc_id: r for r in docs.collect()}
    got = quality_rules.quality_rules(docs, least_docs=least).collect()
    size = lambda r: (len(of[r.doc_id].text) + 1).bit_length() - 1
    past = [(of[r.doc_id].lang, size(r), r.log_ppl, r.fit_ppl) for r in got if not r.base_failed]
    bands = brute_bands(past, least_docs=least)
    assert len(past) > 50
    for r in got:
        if not r.base_failed:
            low, high = bands[of[r.doc_id].lang, size(r)]
            assert abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9 and r.kept == (low <= r.log_ppl and r.fit_ppl <= high)
    assert Counter(x.doc_id for x in quality_rules.keep_good(docs, least_docs=least).collect()) == Counter(r.doc_id for r in got if r.kept)


def test_perplexity_bands_reject_both_sides(spark):
    rng = np.random.default_rng(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran"]
    rows = [(i, " ".join(rng.choice(words, 80)), "en") for i in range(300)]
    rows.append((999, "".join(rng.choice(list("qzxjkvwy#"), 280)) + " a b c d e f g h i j k", "en"))
    rows.append((998, " ".join(["thecatsat" + "e" * (20 + i) for i in range(10)]), "en"))
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert not got[999].kept and got[999].fit_ppl > got[999].high and all(got[i].kept for i in range(300))
    assert not got[998].base_failed


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_upper_band_with_production_parameters(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").where("lang in ('de', 'en') and n_chars between 1023 and 2046").select("doc_id", "text", "lang")
    assert docs.count() >= 400
    clean = docs.join(spark.read.parquet(f"{LARGE}/labels.parquet").where("quality = 1").select("doc_id").distinct(), "doc_id")
    texts = {x: clean.where(F.col("lang") == x).orderBy("doc_id").limit(9).collect() for x in ("de", "en")}
    rng = np.random.default_rng(3)
    rows = [(-1 - k, " ".join("".join(rng.choice(list("0123456789abcdef"), 8)) for _ in range(150)), x) for k, x in enumerate(("de", "en"))]
    rows += [(-10 - k, a.text[:800] + "\n" + b.text[:800], x) for k, (a, b) in enumerate(zip(texts["de"], texts["en"])) for x in ("de", "en")[k % 2 :][:1]]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.unionAll(spark.createDataFrame(rows, docs.schema))).where("doc_id < 0").collect()}
    assert not any(r.base_failed for r in got.values()) and len(got) == len(rows) == 11
    assert {i for i, r in got.items() if not r.kept} == {-1, -2}


@tables
def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) >= 0.9 * len(test)


def letter(c):
    return language_id.letter_vectors(np.array([ord(c)]))[0].astype(np.float64)


def brute_bundle(text):
    """The sum of bound trigram vectors, letter by letter; None without a letter."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    s = "".join(x if c.isalpha() else " " for c, x in zip(text, low))
    s = " " + re.sub(" +", " ", s).strip(" ") + " "
    out = np.zeros(language_id.DIM)
    for g, n in Counter(s[i : i + 3] for i in range(len(s) - 2)).items() if s.strip() else ():
        out += n * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
    return out if s.strip() else None


def brute_languages(rows, learn):
    """lang_pred and score of each row (id, text, lang)."""
    sums = {}
    for i, t, x in rows:
        if learn(i) and x is not None and t and (v := brute_bundle(t)) is not None:
            sums[x] = sums.get(x, 0) + v
    langs = sorted(sums)
    out = []
    for i, t, _ in rows:
        v = brute_bundle(t or "")
        if v is None or not langs:
            out.append((i, "und", 0.0))
            continue
        cos = np.array([v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x]) for x in langs])
        e = np.exp(20 * (cos - cos.max()))
        out.append((i, langs[int(cos.argmax())], e.max() / e.sum()))
    return out


def same_languages(got, want):
    got, want = sorted(got, key=lambda x: (x[0] is None, x[0])), sorted(want, key=lambda x: (x[0] is None, x[0]))
    return [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(got, want))


def test_language_brute(spark):
    texts = ["abc bca, ça!", "", "12 34", "ab", "a", None, "кот спит", "日本語 𝓐", "İstanbul ẞ", " x1y2 z", "the cat", "la ça est", "the dog and the cat", "le chat est là"]
    rows = [(i, t, ("en", "fr", None, "ru")[i % 4]) for i, t in enumerate(texts)]
    want = brute_languages(rows, lambda i: i != 4)
    for parts in (1, 5):  # a score does not hang on which texts share a batch
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        assert same_languages([tuple(r) for r in language_id.identify(df, F.col("doc_id") != 4).collect()], want)


@tables
def test_language_query_brute(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_languages(rows, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    assert same_languages([(r.doc_id, r.lang_pred, r.score) for r in queries.op2_language_id(spark, SF).collect()], want)


def test_language_odd(odd):
    rows = language_id.identify(odd, F.col("doc_id") > 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}


def test_tokens(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    model = tokenizers.Tokenizer.from_file(path)
    extra = ["<|endoftext|>a<|startoftext|> b", "ΑΣ ΟΔΟΣ. İ", "it's I'LL ５ ½ Ⅷ\x1c\x85", "é don't!!??", "a<|endoftext"]
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(extra, 100)), "doc_id long, text string"))
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in df.collect())
    assert Counter(map(tuple, token_count.token_counts(df, path).collect())) == want


def brute_lines(rows, min_words):
    firsts, gone, order = {}, defaultdict(set), sorted((i, t) for i, t in {(i, t) for i, t in rows if i is not None and t is not None})
    for i, t in order:
        lines = t.split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += n[b]
                if total >= min_words:
                    if n[a]:
                        run = tuple(lines[a : b + 1])
                        if run in firsts:
                            gone[i].update(range(a, b + 1))
                        else:
                            firsts[run] = (i, a)
                    break
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in order}


def test_line_dedup(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"l{k}w{j}" for j in range(rng.integers(1, 9))) for k in range(25)] + ["", "same"]
    rows = [(i, "\n".join(lines[k] for k in rng.integers(0, len(lines), 6).tolist() + list(range(5 * (i % 4), 5 * (i % 4) + 4)))) for i in range(60)] + [(61, None), (62, ""), (63, "\n\n"), (None, lines[0])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=12)
    assert {r.doc_id: r.clean_text for r in got.collect() if r.doc_id is not None and r.doc_id != 61} == brute_lines(rows, 12)
    assert sum(r.n_removed_lines for r in got.collect()) > 0


def brute_common_runs(rows, min_words):
    """Every run of lines of min_words words that stood before goes, whatever its length."""
    firsts, gone, order = set(), defaultdict(set), sorted((i, t) for i, t in rows)
    for i, t in order:
        lines = t.split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n[a : b + 1]) >= min_words:
                    run = tuple(lines[a : b + 1])
                    if run in firsts:
                        gone[i].update(range(a, b + 1))
                    firsts.add(run)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in order}


def test_line_dedup_whole_matches(spark):
    passage = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate((60, 40))]
    rows = [(1, "\n".join(["start one", *passage, "end one"])), (2, "\n".join(["other start", *passage, "another end"]))]
    got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other start\nanother end"}
    rng = np.random.default_rng(10)
    lines = [" ".join(f"l{k}w{j}" for j in range(rng.integers(1, 9))) for k in range(40)] + ["", " "]
    rows = []
    for i in range(80):
        a, n = int(rng.integers(0, 36)), int(rng.integers(2, 6))
        parts = [f"own {i}", *lines[a : a + n], *["", ""][: i % 3], f"{i} own", *[lines[k] for k in rng.integers(0, 42, 4)], *lines[a : a + i % 4]]
        rows.append((i, "\n".join(parts)))
    rows.append((80, rows[3][1]))
    got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=12).collect()}
    assert got == brute_common_runs(rows, 12) != brute_lines(rows, 12)


def test_sharding(spark, odd, none):
    assert sharding.shard(none).count() == 0
    rng = np.random.default_rng(6)
    rows = [(int(i), "x" * int(n)) for i, n in enumerate(rng.pareto(1.5, 4000) * 20)] + [(-5, None), (None, "null id"), (1 << 62, "far"), (-(1 << 63), "low")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=7).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 7 and sizes.max() <= 1.1 * sizes.mean() + out["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert out.sort_values("doc_id")["shard"].dropna().is_monotonic_increasing or out["doc_id"].isna().any()
    got = {(r.doc_id, r.size, r.text_crc32) for r in sharding.shard(odd, shards=3).collect()}
    assert got == {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows()}


def test_knapsack():
    rng = np.random.default_rng(7)
    for _ in range(40):
        lengths, counts, budget = np.arange(3, 3 + rng.integers(1, 6)), rng.integers(0, 4, 8), int(rng.integers(0, 60))
        counts = counts[: len(lengths)]
        sums = {0}
        for x, n in zip(lengths, counts):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}, [1, 2, 3], 3) == pytest.approx({"a": 200 / 3, "b": 400 / 3})
    out = mixing.targets({"a": 1000, "b": 10}, [1, 2, 3], 3)
    assert out == pytest.approx({"b": 30, "a": 980}) and mixing.targets({}, [1], 3) == {}


def test_mixing(spark, odd, none):
    assert mixing.mix(none, with_texts=False).count() == 0
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("w" * int(n)), f"s{i % 5}" if i % 11 else None) for i, n in enumerate(rng.integers(0, 60, 900))]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string").repartition(4)
    one, two = (sorted(map(tuple, mixing.mix(df, with_texts=w).select("doc_id", "__size", "__taken").collect())) for w in (False, True))
    assert one == two and all(0 <= t <= 3 * s for _, s, t in one)
    by = mixing.mix(df).groupBy("source").agg(F.first("__target"), F.sum("__taken")).collect()
    assert len(by) == 6 and all(abs(r[1] - r[2]) <= 1 for r in by)
    assert mixing.mix(odd, with_texts=False).count() == len(odd_rows())


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/1", "ftp://x.net/es/", "http://x.net", "no scheme", None, "://", "http://h.org#f/en", "http://example.com.evil.org/en/", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills cheap pills spam farm</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("x.net", "/es/", "net/es/", "block") and got[3][:3] == ("x.net", "", None) and got[4][:3] == ("", "", None) == got[5][:3] == got[6][:3]
    assert got[7][:3] == ("h.org", "", None) and got[8][2] is None and got[9][2] == "com/"


def words_of(counts):
    names = list(counts)
    return url_filter.Words(url_filter.hashes(names), np.array(list(counts.values())), sorted({len(x) for x in names}), sum(counts.values()))


def brute_split(name, counts):
    total = sum(counts.values()) or 1
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            piece = name[start:end]
            unknown = np.log(total * 10.0) + 2.3 * len(piece)
            cost = min(unknown, np.log(total / counts[piece])) if piece in counts else unknown
            options.append((best[start][0] + cost, [*best[start][1], piece]))
        best.append(min(options, key=lambda x: x[0]))
    return best[-1]


def cost_of(words, counts):
    total = sum(counts.values()) or 1
    return sum(min(np.log(total * 10.0) + 2.3 * len(w), np.log(total / counts[w]) if w in counts else np.inf) for w in words)


def test_segmenter():
    counts = {"cheap": 50, "pills": 40, "spam": 30, "farm": 30, "a": 100, "ill": 3, "c" * 80: 2}
    cut = url_filter.Segmenter(words_of(counts))
    assert cut.split("cheappills") == ["cheap", "pills"] and cut.split("spamfarm") == ["spam", "farm"] and "".join(cut.split("zzqcheap")) == "zzqcheap" and cut.split("") == []
    assert cut.split("spam" + "c" * 80) == ["spam", "c" * 80]
    rng = np.random.default_rng(11)
    for _ in range(60):
        name = "".join(rng.choice(["cheap", "pills", "spam", "a", "z", "ill", "q"], int(rng.integers(1, 7))))
        assert "".join(cut.split(name)) == name and abs(cost_of(cut.split(name), counts) - brute_split(name, counts)[0]) < 1e-9


def test_text_of():
    assert url_filter.text_of("a<script>var x='<p>';</SCRIPT >b<style>p{}</style><p class='x'>c</p>").split() == ["a", "b", "c"]
    assert url_filter.text_of("a <script> b <p>c") == "a   b  c" and url_filter.text_of("x < y") == "x < y"
    for bad in ("<script" * 200_000, "<style>" * 200_000, "<" * 1_000_000, "<script>" + "</script " * 100_000):
        began = time.time()
        url_filter.text_of(bad)
        assert time.time() - began < 5


def test_bayes():
    model = url_filter.Bayes([("allow", "good", 9), ("block", "bad", 9)], {"allow": 5, "block": 5}, {"allow": 9, "block": 9}, 2)
    assert model.verdict(["bad"]) == "block" and model.verdict(["good"]) == "allow" and url_filter.Bayes([], {}, {}, 0).verdict(["x"]) == "allow"


def brute_urls(pages):
    """verdict of each page (id, url, html), by the rules or else by segmentation and naive Bayes over whole counts."""
    counts = Counter(w for _, _, html in pages for w in re.findall(r"[^\W\d_]+", url_filter.text_of(html or "").lower()) if len(w) > 1)

    def cut(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = fold(re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        return host, path

    def rule(host, path):
        fits = [(len(h + p), v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    known = {}

    def tokens(host, path):
        out = []
        for x in re.findall(r"[^\W_]+", host):
            if x not in known:
                known[x] = brute_split(x, counts)[1]
            out += ["h:" + w for w in known[x]]
        return out + ["p:#" if x.isdigit() else "p:" + x for x in re.findall(r"[^\W_]+", path.lower())]

    cuts = {i: cut(u) for i, u, _ in pages}
    verdicts = {i: rule(*c) for i, c in cuts.items()}
    docs, sums = Counter(v for v in verdicts.values() if v), Counter((v, t) for i, v in verdicts.items() if v for t in tokens(*cuts[i]))
    seen = {t for _, t in sums}
    names = sorted(docs) or ["allow"]
    of = {v: sum(n for (w, _), n in sums.items() if w == v) for v in names}
    out = {}
    for i, v in verdicts.items():
        score = [np.log(docs[x] / sum(docs.values())) + sum(np.log((sums[x, t] + 1) / (of[x] + len(seen) + 1)) for t in tokens(*cuts[i]) if t in seen) for x in names]
        out[i] = (*cuts[i], v or names[int(np.argmax(score))])
    return out


@tables
@pytest.mark.parametrize("bound", [1 << 20, 100])
def test_urls_brute(spark, bound):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = url_filter.judge(pages.withColumns({"block": F.lit(1), "verdict": F.lit("x")}), queries.URL_RULES, bound=bound) if bound == 100 else queries.op4_url_filter(spark, SF)
    got = {r.page_id: (r.host, r.path, r.verdict) for r in got.collect()}
    want = brute_urls(rows)
    assert got == want and len({v for *_, v in want.values()}) == 2


def test_classifier(spark, odd):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 3 else ["spam", "junk", "buy"], 40)), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scores = {r.doc_id: r.score for r in quality_classifier.classify(df, df, F.col("doc_id") % 4 != 2).collect()}
    assert all((scores[i] >= 0.5) == bool(q) for i, _, q in rows if i % 4 == 2)
    labels = spark.createDataFrame([(7, 1), (12, 0), (500, 1), (9, None)], "doc_id long, quality int")
    out = quality_classifier.classify(odd, labels, F.lit(True)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_classifier.classify(odd, labels, F.lit(False)).collect()} == {0.5}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        jaccard_join.jaccard_components(none), decontaminate.contamination(none, bench), quality_rules.quality_rules(none), quality_rules.keep_good(none),
        language_id.identify(none, F.lit(True)), token_count.token_counts(none, queries.tokenizer_path()), line_dedup.dedup_lines(none), url_filter.judge(pages, queries.URL_RULES), quality_classifier.classify(none, labels, F.lit(True)),
    ):
        assert out.count() == 0
