"""Detectors over packet-like tables: keyed continuous queries that yield firings.

The tables need a clock `t` and an order `seq` besides the columns that each function names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import entropy, left_label, median_of, registered_domain
from .primitives import distinct_within, last_before, last_n, ordered, rate, rates, recent, scanned, window_hits


def detection_filter(df: DataFrame, track: str, n: int, span: int) -> DataFrame:
    """Rows that complete n matches of the tracked address within span."""
    return window_hits(df, [track], n, span)


def syn_flood(outcomes: DataFrame, key: str, n: int, span: int, ratio: float, max_ports: int, incomplete: Column, port: str = "dport") -> DataFrame:
    """Handshake outcomes that end a run of n incomplete ones within span, of which incomplete outcomes make up the ratio since its first,
    spread over at most max_ports server ports."""
    marked = outcomes.withColumn("__bad", incomplete.cast("long"))
    whole = ordered([key]).rowsBetween(Window.unboundedPreceding, 0)
    # completed handshakes so far, so that those since any earlier row are a difference
    good = F.sum(1 - F.col("__bad")).over(whole)
    # strictly before the clock value of the oldest: those of the same time count as since it
    before = F.coalesce(F.sum(1 - F.col("__bad")).over(Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = marked.withColumn("__good", good).withColumn("__before", before).where("__bad = 1")
    bad = distinct_within(bad, [key], port, span, out="ports")
    back = F.lag("__before", n - 1).over(ordered([key]))
    oldest = F.lag("t", n - 1).over(ordered([key]))
    bad = bad.withColumn("completed", F.col("__good") - back).withColumn("oldest", oldest).where(F.col("t") - F.col("oldest") <= span)
    return bad.where((F.lit(n) / (F.lit(n) + F.col("completed")) >= ratio) & (F.col("ports") <= max_ports)).drop("__bad", "__good", "__before")


def distinct_scan(probes: DataFrame, key: list[str], value: str, n: int, span: int) -> DataFrame:
    """Probes by which a key has reached n distinct values within span (port scan, host sweep, ping sweep)."""
    return distinct_within(probes, key, value, span, least=n)


def rate_flood(df: DataFrame, key: list[str], value: Column, span: int, least: int, replies: Column | None = None, max_reply_ratio: float = 0.02) -> DataFrame:
    """Forward rows whose ring sum reaches least, with replies (rows where `replies` holds) no more than the ratio of the packets."""
    if replies is None:
        return rate(df, key, value, span).where(F.col("rate") >= least)
    forward = (~replies).cast("long")
    way = F.col("__fwd")
    rows = rates(df.withColumn("__fwd", forward), key, {"rate": value * way, "packets": way, "replies": 1 - way}, span)
    return rows.where((F.col("__fwd") == 1) & (F.col("rate") >= least) & (F.col("replies") <= max_reply_ratio * F.col("packets"))).drop("__fwd")


def unsolicited(df: DataFrame, key: list[str], request: Column, reply: Column, idle: int) -> DataFrame:
    """Replies without a request of their key within idle before them."""
    return df.withColumn("__asked", recent(key, "t", request, idle)).where(reply & ~F.col("__asked")).drop("__asked")


def solicited(df: DataFrame, key: list[str], request: Column, reply: Column, idle: int) -> DataFrame:
    """Replies with the time of the latest request of their key, at most idle before."""
    return df.withColumn("asked_t", last_before(key, "t", request)).where(reply & (F.col("t") - F.col("asked_t") <= idle))


def flow_starts(df: DataFrame, key: list[str], idle: int) -> DataFrame:
    """Rows that open a flow: the first of their key, or after more than idle without any."""
    last = F.lag("t").over(ordered(key))
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("t") - F.col("__last") > idle)).drop("__last")


def tunnel_sizes(df: DataFrame, key: list[str], size: str, entropy_: str, n: int, span: int, least_sizes: int = 3, least_entropy: float = 6.0) -> DataFrame:
    """The last n odd payloads within span with many sizes or high mean entropy."""
    frame = last_n(key, n)
    rows = df.withColumn("sizes", F.size(F.array_distinct(F.collect_list(size).over(frame))).cast("long")).withColumn("mean_entropy", F.avg(entropy_).over(frame))
    return window_hits(rows, key, n, span).where((F.col("sizes") >= least_sizes) | (F.col("mean_entropy") > least_entropy))


def fragment_overlaps(frags: DataFrame, key: list[str], start: str, end: str, span: int) -> DataFrame:
    """Fragments that overlap an earlier one of their datagram (not an exact copy) less than span before.

    State is the different fragments of one span, each with its last time, sorted by where they begin."""

    def fold():
        last: dict[tuple[int, int], int] = {}  # in order of last time
        ordered: list[tuple[int, int]] = []  # by start
        longest = 0

        def add(now, a, z):
            nonlocal longest
            while last and now - last[first := next(iter(last))] >= span:
                del last[first], ordered[bisect_left(ordered, first)]
            at = bisect_left(ordered, (z,))
            hit = False
            while at and ordered[at - 1][0] > a - longest and not hit:
                at -= 1
                hit = ordered[at][1] > a and ordered[at] != (a, z)
            if last.pop((a, z), None) is None:
                insort(ordered, (a, z))
                longest = max(longest, z - a)
            last[a, z] = now
            return (1,) if hit else None

        return add

    return scanned(frags, key, fold, [start, end], [T.StructField("__hit", T.IntegerType())]).drop("__hit")


def tiny_fragment(offset: Column, more: Column, length: Column, header: int, min_size: int) -> Column:
    """A first fragment too short for its transport header, or a middle one under min_size."""
    return ((offset == 0) & more & (length < header)) | ((offset > 0) & more & (length < min_size))


def oversize_fragment(offset: Column, length: Column) -> Column:
    return offset + length > 65535


def binding_changes(df: DataFrame, ip: str, mac: str, idle: int) -> DataFrame:
    """Rows where an address is claimed by another MAC than last, less than idle after: with the old one as old_mac."""
    w = ordered([ip])
    rows = df.withColumn("old_mac", F.lag(mac).over(w)).withColumn("__t", F.lag("t").over(w))
    return rows.where((F.col("old_mac") != F.col(mac)) & (F.col("t") - F.col("__t") <= idle)).drop("__t")


def flip_flops(df: DataFrame, ip: str, mac: str, idle: int, n: int, span: int, memory: int = 8) -> DataFrame:
    """Binding changes back to one of the last `memory` MACs of the address, n of them within span."""
    changes = binding_changes(df, ip, mac, idle)
    past = F.collect_list("old_mac").over(Window.partitionBy(ip).orderBy("t", "seq").rowsBetween(-(memory - 1), 0))
    back = changes.withColumn("__past", past).where(F.array_contains("__past", F.col(mac))).drop("__past")
    return window_hits(back, [ip], n, span)


def amplification(df: DataFrame, key: list[str], response: Column, query: Column, span: int, min_bytes: int, min_ratio: float, unmatched: Column | None = None) -> DataFrame:
    """Rows whose key got min_bytes of responses in the ring, and min_ratio times the bytes of its queries; or min_bytes of unmatched ones alone."""
    rows = rates(df, key, {"response_bytes": response, "query_bytes": query} | ({"unmatched_bytes": unmatched} if unmatched is not None else {}), span)
    much = (F.col("response_bytes") >= min_bytes) & (F.col("response_bytes") >= min_ratio * F.col("query_bytes"))
    if unmatched is None:
        return rows.where(much)
    return rows.where((F.col("unmatched_bytes") >= min_bytes) | much)


def tunnel_subdomains(df: DataFrame, key: list[str], name: str, n: int, span: int, min_entropy: float, min_length: float) -> DataFrame:
    """Queries by which a key has asked for n distinct subdomains of one registered domain, of high entropy or great length on average."""
    rows = df.withColumn("domain", registered_domain(F.col(name))).withColumn("sub", left_label(F.col(name)))
    rows = distinct_within(rows, [*key, "domain"], "sub", span, keep="subs", least=n)
    m = F.size("subs")
    rows = rows.withColumn("avg_entropy", F.aggregate("subs", F.lit(0.0), lambda a, s: a + entropy(s)) / m)
    rows = rows.withColumn("avg_length", F.aggregate("subs", F.lit(0.0), lambda a, s: a + F.length(s)) / m)
    return rows.where((F.col("avg_entropy") >= min_entropy) | (F.col("avg_length") >= min_length)).drop("subs")


def nxdomain_burst(df: DataFrame, client: str, name: str, n: int, span: int, min_entropy: float) -> DataFrame:
    """Answers by which a client has met n distinct unknown names within span, half of them or more with a random-looking first label."""
    rows = distinct_within(df, [client], name, span, keep="names", least=n)
    random = F.size(F.filter("names", lambda x: entropy(left_label(x)) >= min_entropy))
    return rows.withColumn("n_random", random.cast("long")).where(F.col("n_random") * 2 >= F.size("names")).drop("names")


def beacon_scores(starts: DataFrame, key: list[str], keep: int = 32, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Each connection start with its rank, the lower median of the key's last gaps and the share of gaps near the median or twice it."""
    w = ordered(key)
    rows = starts.withColumn("n", F.row_number().over(w).cast("long")).withColumn("gap", F.col("t") - F.lag("t").over(w))
    gaps = F.array_sort(F.filter(F.collect_list("gap").over(w.rowsBetween(-(keep - 2), 0)), lambda g: g.isNotNull()))
    rows = rows.withColumn("gaps", gaps).withColumn("median_gap", F.when(F.size("gaps") > 0, median_of(F.col("gaps"))))
    m = F.col("median_gap")
    near = F.filter("gaps", lambda g: g.between(m * low, m * high) | g.between(2 * m * low, 2 * m * high))
    return rows.withColumn("share", F.when(F.size("gaps") > 0, F.size(near) / F.size("gaps"))).drop("gaps")


def beacons(starts: DataFrame, key: list[str], min_events: int, every: int = 8, streak: int = 4, min_share: float = 0.7, low_gap: int = 0, high_gap: int = 1 << 62, **band) -> DataFrame:
    """Checkpoints (at min_events, then every `every`-th start) at which a key passes for the streak-th time in a row."""
    scored = beacon_scores(starts, key, **band).where((F.col("n") >= min_events) & ((F.col("n") == min_events) | (F.col("n") % every == 0)))
    w = Window.partitionBy(*key).orderBy("n")
    passed = F.col("median_gap").between(low_gap, high_gap) & (F.col("share") >= min_share)
    rows = scored.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("__run", F.sum((~F.col("passed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__in", F.sum(F.col("passed").cast("int")).over(Window.partitionBy(*key, "__run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("__in") == streak) & F.col("passed")).drop("__run", "__in")


def interval_totals(df: DataFrame, host: str, interval: int, value: Column) -> DataFrame:
    """The value of each host in each aligned interval, with empty intervals between its first and last as 0."""
    aligned = F.col("t") - F.pmod(F.col("t") + F.lit(62_135_596_800_000_000), F.lit(interval))
    sums = df.groupBy(host, aligned.alias("start")).agg(F.sum(value).cast("double").alias("x"))
    ends = sums.groupBy(host).agg(F.min("start").alias("a"), F.max("start").alias("b"))
    grid = ends.select(host, F.explode(F.sequence("a", "b", F.lit(interval))).alias("start"))
    return grid.join(sums, [host, "start"], "left").select(host, "start", F.coalesce("x", F.lit(0.0)).alias("x"))


def baseline(totals: DataFrame, host: str, learn: int, alpha: float = 0.1, threshold: float = 6.0, floor: float = 1.0, sustain: int = 1) -> DataFrame:
    """Intervals whose value stands out from the host's learned mean: plain mean and mean deviation over `learn` intervals, then an
    exponential average that stands still while the score is at or over the threshold. A fold over each host's intervals, in the JVM."""
    series = totals.groupBy(host).agg(F.array_sort(F.collect_list(F.struct("start", "x"))).alias("s")).where(F.size("s") > learn)
    head = F.transform(F.slice("s", 1, learn), lambda p: p["x"])
    mean = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / learn
    series = series.withColumn("m0", mean)
    dev = F.aggregate(head, F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m0"))) / learn
    series = series.withColumn("d0", dev)
    shape = "array<struct<start:bigint,x:double,mean:double,dev:double,score:double>>"
    zero = F.struct(F.col("m0").alias("m"), F.col("d0").alias("d"), F.lit(0).alias("run"), F.array().cast(shape).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        score = (p["x"] - acc["m"]) / F.greatest(acc["d"], F.lit(floor))
        odd = score >= threshold
        run = F.when(odd, acc["run"] + 1).otherwise(0)
        m = F.when(odd, acc["m"]).otherwise(acc["m"] + alpha * (p["x"] - acc["m"]))
        d = F.when(odd, acc["d"]).otherwise(acc["d"] + alpha * (F.abs(p["x"] - acc["m"]) - acc["d"]))
        fired = F.array(F.struct(p["start"].alias("start"), p["x"].alias("x"), acc["m"].alias("mean"), acc["d"].alias("dev"), score.alias("score")))
        return F.struct(m.alias("m"), d.alias("d"), run.alias("run"), F.when(odd & (run >= sustain), F.concat(acc["out"], fired)).otherwise(acc["out"]).alias("out"))

    rest = F.slice("s", learn + 1, F.greatest(F.size("s") - learn, F.lit(0)))
    return series.select(host, F.explode(F.aggregate(rest, zero, step)["out"]).alias("o")).select(host, "o.*")


def concurrent(intervals: DataFrame, key: str, enter: str, leave: str, n: int) -> DataFrame:
    """Entries at which at least n intervals of the key are open (leaves count before entries of the same time)."""
    events = intervals.select(key, "seq", F.col(enter).alias("t"), F.lit(1).alias("d")).unionAll(intervals.select(key, "seq", F.col(leave).alias("t"), F.lit(-1).alias("d")))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("t", "d", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("open", running).where((F.col("d") == 1) & (F.col("open") >= n)).drop("d")
