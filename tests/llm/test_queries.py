"""The queries that SQL can't express, on the whole smallest tables, against brute-force versions or exact properties."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import SF, WORD, brute_common_runs, brute_counts, brute_lines

from packetloom.llm import decontaminate, line_dedup, mixing, quality_classifier, queries, runtime, sharding

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op3(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = {(i, len(r.text.encode()), n, n > 2048) for i, r in docs.items() for n in [len(model.encode(r.text, add_special_tokens=False).ids)]}
    rows = queries.op3_token_counts(spark, SF).collect()
    assert set(map(tuple, rows)) == want and len(rows) == len(docs)


def test_op6(spark, docs):
    want = brute_common_runs([(i, r.text) for i, r in docs.items()], 50)
    rows = queries.op6_line_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text
        assert r.clean_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_lines == text.count("\n") + 1 and r.n_removed_words == len(WORD.findall(text)) - len(WORD.findall(want[r.doc_id]))
    assert sum(r.n_removed_lines for r in rows) > 0 and want != brute_lines([(i, r.text) for i, r in docs.items()], 50)


def test_line_dedup_columns_and_blank_lines(spark):
    long = "\n" * 20_000 + " ".join(f"w{i}" for i in range(60)) + "\n" * 20_000
    df = spark.createDataFrame([(1, long, 5), (2, long, 6)], "doc_id long, text string, spans int").withColumn("print", F.lit("x"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].clean_text == long and WORD.findall(got[2].clean_text) == [] and got[2].n_removed_words == 60


def test_op7(spark, docs):
    rows = queries.op7_sharding(spark, SF).toPandas()
    assert list(rows.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = {(i, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for i, r in docs.items()}
    assert set(rows[["doc_id", "size", "text_crc32"]].itertuples(index=False, name=None)) == want and len(rows) == len(docs)
    assert set(rows["law"]) == {"bytes"} and rows["grown_shard"].isna().all() and rows["shard"].between(0, 39).all()
    for _, part in rows.groupby("shard"):
        assert part.sort_values("doc_id")["slot"].tolist() == list(range(len(part)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() <= rows["size"].sum() / 40 + 1.1 * rows["size"].max()
    assert rows.sort_values("doc_id")["shard"].is_monotonic_increasing


def test_sharding_hot_ids_and_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "t%d " % i * int(rng.integers(1, 9)), i, "a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, tie string, piece string").repartition(4)
    out = sharding.shard(df, shards=6)
    assert out.columns[:5] == df.columns
    out = out.toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 6 and sizes.max() <= 1.1 * sizes.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert Counter(out["key"]) == Counter(r[2] for r in rows)


def test_op8(spark, tmp_path):
    rows = queries.op8_quality_classifier(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    # labels of held-out rows, lang, source and doc_id decide nothing
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        table = table.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string")}) if name == "documents" else table.withColumn("quality", F.when(queries.fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    again = {r.doc_id: r.score for r in queries.op8_quality_classifier(spark, str(tmp_path)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_classifier_features():
    """Buckets of each text alone equal those among others; words, pairs and 3- and 4-grams of characters."""
    import pyarrow as pa

    texts = ["Ein Haus, ein Haus", "", "日本語の文 x", "ab", " \n "]
    many, who = quality_classifier.features(pa.array(texts, pa.large_string()))
    for d, text in enumerate(texts):
        alone, _ = quality_classifier.features(pa.array([text], pa.large_string()))
        w = [x.lower() if x.isascii() else x for x in WORD.findall(text)]
        grams = sum(max(0, len(x) - n + 1) for x in w for n in (3, 4))
        assert Counter(many[who == d].tolist()) == Counter(alone.tolist()) and len(alone) == len(w) + max(0, len(w) - 1) + grams


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_op8_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    one, zero = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in one for b in zero]) > 0.9 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def test_op9(spark, docs):
    sizes = {i: len(WORD.findall(r.text)) for i, r in docs.items()}
    per = defaultdict(int)
    for i, r in docs.items():
        per[r.source] += sizes[i]
    goal = dict(per)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    free, left, goal = set(order), float(sum(per.values())), {}
    while free:  # shares by weight; what is above 3 times its source stops there
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * per[s]}
        goal |= {s: float(3 * per[s]) for s in full} if full else share
        left -= sum(goal[s] for s in full)
        free = free - full if full else set()
    rows = queries.op9_mixing(spark, SF).collect()
    taken = defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], per[s]) and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert len(rows) == len(docs)
    most = max(sizes.values())
    assert all(abs(taken[s] - goal[s]) <= min(most, 0.02 * goal[s] + 60) for s in order)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, queries.op9_mixing(spark, SF).collect()))


def test_mixing_columns(spark):
    rows = [(i, "w " * (i % 7), "s%d" % (i % 3), i, "x", 1, 2, 3, 4) for i in range(200)]
    names = ["part", "ties", "budget", "allowed", "e_hash", "size"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" if n == "ties" else f"{n} long" for n in names))
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "__size", "__source_size", "__target", "__taken"]
    assert Counter(r.part for r in out.collect()) == Counter(r[3] for r in rows)


def test_op10(spark, docs):
    rows = queries.op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, again = brute_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        failed = n < 10 or 100 * again > 20 * n
        assert r.base_failed == failed and r.kept == (not failed and r.low <= r.log_ppl and r.fit_ppl <= r.high)


def test_decontaminate_columns(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 3)], "item_id long, text string, whole_text int")
    rows = [(1, "a one two three four five six seven eight nine ten b", 1, 2, 3, 4), (2, "clean", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole_text int, __words int, n_words int, hit_spans int")
    assert [tuple(r) for r in decontaminate.decontaminate(df, bench).collect()] == [rows[1]]
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert re.sub(" +", " ", left[1]) == "a b" and left[2] == "clean"
    found = {r.doc_id: r[decontaminate.COUNTS] for r in decontaminate.contamination(df, bench).collect()}
    assert found == {1: 12, 2: 1}


def test_shared_folder(spark, monkeypatch):
    class Far:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            @staticmethod
            def getConf():
                return {}

    given = runtime.shared_dir(spark)
    assert given.startswith("file:")
    monkeypatch.setattr(type(spark.conf), "get", lambda *a: None)
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Far)
