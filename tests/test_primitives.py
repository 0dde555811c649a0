"""Primitives against small Python models, with many ties."""

import random
from collections import deque

import pytest

from packetloom.functions import scalars as S
from packetloom.operators import detectors as D
from packetloom.operators import predicates as P
from packetloom.operators import primitives as K
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    t, out = 0, []
    for seq in range(1500):
        t += rng.choice([0, 0, 1, 2, 7, 30])
        out.append((seq, t, rng.choice("abc"), rng.randrange(12)))
    return out


@pytest.fixture(scope="module")
def table(spark, events):
    return spark.createDataFrame(events, "seq long, t long, key string, v long").repartition(3).cache()


def test_window_hits(table, events):
    want, rings = set(), {}
    for seq, t, key, _ in events:
        ring = rings.setdefault(key, deque(maxlen=5))
        ring.append(t)
        if len(ring) == 5 and t - ring[0] <= 40:
            want.add((seq, ring[0]))
    assert {(r.seq, r.oldest) for r in K.window_hits(table, ["key"], 5, 40).collect()} == want


def test_distinct_within(table, events):
    want, last = {}, {}
    for seq, t, key, v in events:
        last[key, v] = t
        want[seq] = sum(k == key and t - u <= 50 for (k, _), u in last.items())
    assert {r.seq: r.n_distinct for r in K.distinct_within(table, ["key"], "v", 50).collect()} == want


def test_rate(table, events):
    want, rings = {}, {}
    for seq, t, key, v in events:
        anchor, last, buckets = rings.get(key, (t, t, {}))
        if (t - anchor) // 8 - (last - anchor) // 8 >= 10:
            anchor, buckets = t, {}
        b = (t - anchor) // 8
        buckets[b] = buckets.get(b, 0) + v
        rings[key] = (anchor, t, buckets)
        want[seq] = sum(x for i, x in buckets.items() if b - 9 <= i <= b)
    assert {r.seq: r.rate for r in K.rate(table, ["key"], F.col("v"), 80).collect()} == want


def test_recent(table, events):
    want, last = {}, {}
    for seq, t, key, v in events:
        want[seq] = key in last and t - last[key] <= 20
        if v == 0:
            last[key] = t
    got = table.withColumn("r", K.recent(["key"], "t", F.col("v") == 0, 20))
    assert {r.seq: r.r for r in got.collect()} == want


def test_dedup_windows(table, events):
    want, open_ = [], {}
    for seq, t, key, v in events:
        w = open_.get(key)
        if w and t - w[1] < 60:
            w[2], w[3] = t, w[3] + 1
        else:
            open_[key] = [key, t, t, 1, v]
            want.append(open_[key])
    got = K.dedup_windows(table, ["key"], 60, payload=["v"])
    assert sorted(map(list, got.select("key", "first_t", "last_t", "n", "v").collect())) == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "seq long, t long, key string, v long")
    assert K.dedup_windows(none, ["key"], 60).count() == 0
    assert K.rate(none, ["key"], F.col("v"), 80).count() == 0
    assert D.beacons(none, ["key"], 4).count() == 0


@pytest.mark.parametrize("spec,inside,outside", [
    ("10.0.0.0/8", ["10.1.2.3"], ["11.0.0.1", "x", "2001:db8::1"]), ("!10.0.0.0/8", ["11.0.0.1"], ["10.1.2.3"]),
    ("[10.0.0.0/8,!10.1.0.0/16]", ["10.2.0.1"], ["10.1.0.1", "9.9.9.9"]), ("[!10.1.0.0/16]", ["9.9.9.9"], ["10.1.0.1"]),
    ("2001:db8::/32", ["2001:db8::1", "2001:db8:0:0:1::"], ["2001:db9::1", "10.0.0.1"]), ("any", ["1.1.1.1"], []), ("ff00::/8", ["ff02::1"], ["fe80::1"]),
])
def test_address(spark, spec, inside, outside):
    df = spark.createDataFrame([(x,) for x in inside + outside], "ip string")
    assert sorted(r.ip for r in df.where(P.address("ip", spec)).collect()) == sorted(inside)


@pytest.mark.parametrize("pattern,text,hit", [
    ("x$", "x\n", False), ("a.b", "a\rb", True), (r"\bcat", "écat", True), (r"(?i)k", "K", True), (r"\s", "\x0b", False), (r"[\s]", " ", True), ("a[[]b", "a[b", True), (r"^\d+$", "123", True),
])
def test_regex(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "x string").select(P.matches(F.col("x"), pattern)).first()[0] is hit


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1"])
def test_regex_refused(pattern):
    with pytest.raises(P.RegexError):
        P.translate_regex(pattern)


def test_scalars(spark):
    row = spark.range(1).select(
        F.round(S.entropy(F.lit("gooogle")), 6).alias("h"), S.percent_decode(F.lit("a%2fb%zz+%41%")).alias("p"), S.query_string(F.lit("/x?a=1+%32#f?")).alias("q"),
        S.registered_domain(F.lit("a.b.co.uk")).alias("d"), S.registered_domain(F.lit("www.example.com.")).alias("e"), S.strip_port(F.lit("[::1]")).alias("s"), S.serial_before(F.lit(0xFFFFFFFF), F.lit(1)).alias("b"),
    ).first()
    assert tuple(row) == (1.842371, "a/b%zz+A%", "a=1 2", "b.co.uk", "example.com", "[::1]", True)
    assert S.format_duration(39_000_000) == "39ms" and S.format_duration(3_723_500_000_000) == "1h2m3.5s" and S.parse_size("2K") == 2048
    assert S.fnv1a_64(b"") == 0xCBF29CE484222325


def test_chain_matches_all_pairs():
    """The chain that keeps one entry a stage equals the one over all earlier events."""
    import random

    from packetloom.operators import correlate

    random.seed(4)
    for _ in range(300):
        events = sorted((random.randrange(60), random.randrange(5)) for _ in range(random.randrange(1, 25)))
        best = []
        for i, (t, stage) in enumerate(events):
            best.append(max([(1, 1)] + [(best[j][0] + (s < stage), best[j][1] + 1) for j, (u, s) in enumerate(events[:i]) if s <= stage and t - u <= 9]))
        assert correlate.longest_chain(events, 9) == max(best)


def test_feeds_keep_equal_rows(spark):
    from packetloom.operators import feeds

    rows = spark.createDataFrame([("10.0.0.1", "a.b.example")] * 3 + [("192.0.2.1", "other.example")], "ip string, name string")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.0.0.0/16",)], "entry string")
    assert [r.indicator for r in feeds.ip_feed_join(rows, "ip", nets).collect()] == ["10.0.0.0/16"] * 3
    names = spark.createDataFrame([("b.example",), ("a.b.example",)], "entry string")
    assert [r.indicator for r in feeds.domain_feed_join(rows, "name", names).collect()] == ["b.example"] * 3


def test_address_feeds(spark):
    from packetloom.operators import feeds

    rows = spark.createDataFrame([(x,) for x in ("2001:db8::1", "2001:db8:0:1::5", "2001:0DB8:0:1:0:0:0:6", "2001:db9::1", "10.0.0.1", "nothing", "::1", "1::2::3")], "ip string")
    nets = spark.createDataFrame([("2001:db8::/32",), ("2001:db8:0:1::/64",), ("2001:db8:0:1::5",), ("10.0.0.0/31",), ("0.0.0.0/0",), ("bad",)], "entry string")
    got = {r.ip: r.indicator for r in feeds.ip_feed_join(rows, "ip", nets).collect()}
    assert got == {"2001:db8::1": "2001:db8::/32", "2001:db8:0:1::5": "2001:db8:0:1::5", "2001:0DB8:0:1:0:0:0:6": "2001:db8:0:1::/64", "10.0.0.1": "10.0.0.0/31"}
    lines = ["2001:db8::/32", "fe80::1", "fc00::/6", "::1", "::/0", "2001:db8::/129", "2001:db8::x", "::ffff:0a00:0001", "0.0.0.0/0", "203.0.113.0/24", "10.0.0.0/7", "250.0.0.0/8", "248.0.0.0/5"]
    problems = [r.problem for r in feeds.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), "ip").collect()]
    assert problems == [None, *["reserved"] * 4, *["not an address"] * 2, "IPv4 in IPv6 form", "reserved", None, "reserved", None, "reserved"]


def test_fragment_overlaps(spark):
    rng, rows, t = random.Random(5), [], 0
    for i in range(400):
        t += rng.choice([0, 0, 1, 9, 40])
        a = rng.randrange(60)
        rows.append((i, t, rng.randrange(3), a, a + rng.randrange(7)))
    df = spark.createDataFrame(rows, "seq long, t long, key int, a long, z long")
    want = [x[0] for x in rows if any(y[0] < x[0] and y[2] == x[2] and x[1] - y[1] < 60 and y[3] < x[4] and x[3] < y[4] and y[3:] != x[3:] for y in rows)]
    assert sorted(r.seq for r in D.fragment_overlaps(df, ["key"], "a", "z", 60).collect()) == want


def test_standard_echo(spark):
    from packetloom.functions.scalars import standard_echo

    count = bytes(range(256)) * 6
    good = [b"", count[:56], count[:1400], b"\x99" * 8 + count[8:56], b"\x77" * 16 + count[16:1400], (b"abcdefghijklmnopqrstuvw" * 3)[:32], bytes(64)]
    bad = [b"\x99" * 8, b"\x77" * 16, count[:20] + b"x", b"abcdefghijklmnopqrstuvwxyz", b"\0\0\x01\x01" * 4, b"\xff" * 40, None]
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(good + bad)], "i int, b binary")
    got = [r.ok for r in rows.select("i", standard_echo(rows.b).alias("ok")).orderBy("i").collect()]
    assert got == [True] * len(good) + [False] * len(bad)
