"""Streams give what batches give."""

from packetloom.operators import primitives as K
from packetloom.streaming import stateful


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    done = q.awaitTermination(90)
    q.stop()
    assert done
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 7 % 5 + i * 3, "abc"[i % 3]) for i in range(120)]
    rows.sort(key=lambda r: (r[1], r[0]))
    folder = str(tmp_path / "in")
    for part in (rows[:50], rows[50:90], rows[90:]):
        spark.createDataFrame(part, "seq long, t long, key string").coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema("seq long, t long, key string").option("maxFilesPerTrigger", 1).parquet(folder)
    hits = run(spark, stateful.window_hits(stream, "key", 4, 30), "hits", tmp_path)
    want = K.window_hits(batch, ["key"], 4, 30)
    assert sorted(map(tuple, hits.select("seq", "oldest").collect())) == sorted(map(tuple, want.select("seq", "oldest").collect()))
    out = run(spark, stateful.dedup(stream, "key", 40), "dedup", tmp_path)
    alerts = K.dedup_windows(batch, ["key"], 40)
    assert sorted(map(tuple, out.where("kind = 'alert'").select("key", "first_t").collect())) == sorted(map(tuple, alerts.select("key", "first_t").collect()))
