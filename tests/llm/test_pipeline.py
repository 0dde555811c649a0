"""The corpus pipeline: each stage on what the one before kept, against brute force."""

import os
from collections import Counter

import pytest
from test_ops import brute_components, brute_hits

import corpus_pipeline as P
from packetloom.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept.append((docs, out))
        docs = out
    ids = [Counter(r.doc_id for r in out.select("doc_id").collect()) for _, out in kept]
    before = [[(r.doc_id, r.text) for r in d.collect()] for d, _ in kept[:4]]
    good = Counter(r.doc_id for r in quality_rules.quality_rules(kept[0][0]).where("kept").collect())
    assert ids[0] == good and 0 < sum(good.values()) < len(before[0])
    assert ids[1] == Counter(i for (i, _, root), n in brute_components(before[1]).items() for _ in range(n) if i == root)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[2] == Counter(i for (i, *_, bad), n in brute_hits(before[2], bench).items() for _ in range(n) if not bad)
    taken = Counter({r.doc_id: r["__taken"] // r["__size"] for r in mixing.mix(kept[3][0]).where("__size > 0").collect()})
    assert ids[3] == +taken
    assert ids[4] == ids[3] and kept[4][1].select("shard").distinct().count() <= 40


def test_run(spark):
    got = P.run(spark, SF)
    rows = got.collect()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
