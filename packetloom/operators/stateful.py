"""Folds over one key's rows in time order that no window expresses: DNS transactions, hop distances, fragmented datagrams, slow HTTP.

Rows are partitioned and sorted by Spark and streamed through one fold a key, so that memory is bounded by a key's state, never by
its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .handshake import FIN, RST, SYN, connection
from .primitives import folded

SECOND = 1_000_000_000


DNS_OUTCOMES = "what string, seq long, t long, client string, server string, cport int, id string, qname string, outcome string, query_size long"


class _Transaction:
    """Questions of one (client, server, port, id), at most 8, each for 10 s; a question asked again is the newer one's."""

    idle, most = 10 * SECOND, 8

    def __init__(self):
        self.open: list[list] = []  # qname, qtype, size, t, seq of the row that opened it

    def _row(self, what, seq, t, row, name, outcome=None, size=None):
        return (what, seq, t, row.client, row.server, row.cport, row.id, name, outcome, size)

    def add(self, row) -> Iterable[tuple]:
        self.last = row
        gone = [q for q in self.open if row.t - q[3] > self.idle]
        out = [self._row("close", q[4], q[3] + self.idle + 1, row, q[0]) for q in gone]
        self.open = [q for q in self.open if row.t - q[3] <= self.idle]
        if not row.response:
            same = next((q for q in self.open if q[:2] == [row.qname, row.qtype]), None)
            if same:
                same[2:4] = [row.size, row.t]
                return out
            if len(self.open) == self.most:
                out.append(self._row("close", row.seq, row.t, row, self.open.pop(0)[0]))
            self.open.append([row.qname, row.qtype, row.size, row.t, row.seq])
            return [*out, self._row("open", row.seq, row.t, row, row.qname)]
        if not self.open:
            return [*out, self._row("response", row.seq, row.t, row, row.qname, "unsolicited")]
        hit = next((q for q in self.open if not row.qname or q[:2] == [row.qname, row.qtype]), None)
        if hit is None:
            return [*out, self._row("response", row.seq, row.t, row, row.qname, "mismatch")]
        self.open.remove(hit)
        return [*out, self._row("close", row.seq, row.t, row, hit[0]), self._row("response", row.seq, row.t, row, row.qname, "matched", hit[2])]

    def end(self) -> Iterable[tuple]:
        return [self._row("close", q[4], q[3] + self.idle + 1, self.last, q[0]) for q in self.open]


def dns_transactions(messages: DataFrame) -> DataFrame:
    """Responses (matched, mismatch, unsolicited) and the opening and closing of questions.

    messages: seq, t, client, server, cport, id, response, qname, qtype, size. A response without a question answers the oldest one.
    """
    slim = messages.select("seq", "t", "client", "server", "cport", "id", "response", "qname", "qtype", "size")
    return folded(slim, ["client", "server", "cport", "id"], _Transaction, DNS_OUTCOMES)


def asked_names(events: DataFrame) -> DataFrame:
    """Responses that answer nothing although their client has a question for the name open at the server, on any port and id."""
    from pyspark.sql import Window

    turn = F.when(F.col("what") == "open", 1).when(F.col("what") == "close", -1).otherwise(0)
    w = Window.partitionBy("client", "server", "qname").orderBy("t", "seq", turn.desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("asked", F.sum(turn).over(w))
    return rows.where("what = 'response' and outcome <> 'matched' and asked > 0").drop("asked")


class _Hops:
    """Hop distances of one source: 4 slots, of which those with min_samples are established."""

    def __init__(self, min_samples: int, max_diff: int, slots: int = 4, idle: int = 3600 * SECOND):
        self.min, self.diff, self.slots, self.idle = min_samples, max_diff, slots, idle
        self.seen: list[list[int]] = []  # distance, samples, last t
        self.last: int | None = None

    def add(self, row) -> Iterable[tuple]:
        if self.last is not None and row.t - self.last > self.idle:
            self.seen = []
        self.last = row.t
        dist = next(x for x in (32, 64, 128, 255) if row.ip_ttl <= x) - row.ip_ttl
        known = [d for d, n, _ in self.seen if n >= self.min]
        odd = bool(known) and all(abs(d - dist) > self.diff for d in known)
        slot = next((s for s in self.seen if s[0] == dist), None)
        if slot:
            slot[1:] = [slot[1] + 1, row.t]
        else:
            if len(self.seen) == self.slots:
                loose = [s for s in self.seen if s[1] < self.min] or self.seen
                self.seen.remove(min(loose, key=lambda s: s[2]))
            self.seen.append([dist, 1, row.t])
        return [(row.seq, row.count_t, row.src, row.dst, row.sport, row.dport, row.g, dist)] if odd and row.count_t >= 0 else []

    def end(self) -> Iterable[tuple]:
        return ()


def hop_anomalies(packets: DataFrame, outcomes: DataFrame, min_samples: int = 10, max_diff: int = 3) -> DataFrame:
    """Packets whose hop distance is further than max_diff from every established one of their source, at the time when they count.

    TTLs of 5 or less say nothing. Packets of completed TCP connections are samples only; those of a handshake count when it ends,
    unless it completes. `outcomes` are those of handshake.outcomes.
    """
    from pyspark.sql import Window

    slim = packets.where("ip_ttl > 5 and src is not null").select("seq", "t", "src", "dst", "sport", "dport", "g", "ip_ttl", "tcp_flags")
    tcp = slim.where("g = 'TCP'").select("*", F.lit(None).cast("string").alias("how"))
    ends = outcomes.select("seq", "t", "src", "dst", "sport", "dport", F.lit("TCP").alias("g"), F.lit(None).cast("int").alias("ip_ttl"), F.lit(None).cast("int").alias("tcp_flags"), F.col("outcome").alias("how"))
    both = tcp.unionByName(ends).withColumn("conn", connection())
    w = Window.partitionBy("conn").orderBy("t", "seq", F.col("how").asc_nulls_last())
    before = F.last("how", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(F.col("how").isNotNull(), F.struct("how", "t")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("before", before).withColumn("ahead", ahead).where("how is null")
    # -1: a sample only
    shakes = F.col("tcp_flags").bitwiseAND(SYN) != 0
    when = F.when(shakes & F.col("ahead").isNotNull(), F.when(F.col("ahead.how") == "complete", -1).otherwise(F.col("ahead.t"))).when(F.col("before") == "complete", -1).otherwise(F.col("t"))
    rows = rows.withColumn("count_t", when).drop("conn", "how", "before", "ahead", "tcp_flags")
    every = rows.unionByName(slim.where("g <> 'TCP' and g <> 'ARP'").drop("tcp_flags").withColumn("count_t", F.col("t")))
    return folded(every, ["src"], lambda: _Hops(min_samples, max_diff), "seq long, t long, src string, dst string, sport int, dport int, g string, distance int")


class _Datagram:
    """The fragments of one datagram, from the first one until its timeout; over 64 of them it is given up."""

    def __init__(self, timeout: int = 30 * SECOND, most: int = 64):
        self.timeout, self.most, self.first = timeout, most, None

    def _closed(self) -> list[tuple]:
        row, spans, total = self.first, sorted(self.spans), self.total
        self.first = None
        reach = 0
        for a, z in spans:
            if a > reach:
                break
            reach = max(reach, z)
        whole = total is not None and reach >= total
        return [] if whole or self.over else [(row.seq, row.t + self.timeout, row.src, row.dst, row.g, len(spans))]

    def add(self, row) -> Iterable[tuple]:
        out = self._closed() if self.first is not None and row.t >= self.first.t + self.timeout else []
        if self.first is None:
            self.first, self.spans, self.total, self.over = row, set(), None, False
        span = (row.frag_offset, row.frag_offset + row.frag_len)
        if span not in self.spans and not self.over:
            self.over = len(self.spans) == self.most
            if not self.over:
                self.spans.add(span)
                self.total = self.total if row.more_fragments else span[1]
        return out

    def end(self) -> Iterable[tuple]:
        return self._closed() if self.first is not None else ()


def incomplete_datagrams(packets: DataFrame) -> DataFrame:
    """Datagrams whose fragments did not all come within 30 s: t is their deadline, seq their first fragment's."""
    frags = packets.where("frag_offset > 0 or more_fragments").select("seq", "t", "src", "dst", "g", "ip_proto", "ip_id", "frag_offset", "more_fragments", "frag_len")
    return folded(frags, ["src", "dst", "ip_proto", "ip_id"], _Datagram, "seq long, t long, src string, dst string, g string, n_frags int")


#: The least deviation that a metric's score divides by, and the least value that counts as high.
FLOORS = {"packets": 10.0, "bytes": 10000.0, "conns": 0.5, "dns": 0.2, "dsts": 10.0, "fanout": 10.0}
LEVELS = {"packets": 10.0, "bytes": 10000.0, "conns": 2.0, "dns": 1.0, "dsts": 20.0, "fanout": 20.0}


class Learned:
    """One metric of one host: plain mean and mean deviation over the first intervals, then averages that move by alpha, by at most
    max_step, and stand still while the value stands out (for up to 60 intervals). Fires once a run, at its sustain-th interval."""

    def __init__(self, interval: int, learn: int, threshold: float, sustain: int, max_step: float, levels: dict[str, float], drop: set[str], alpha: float = 0.1, adapt: int = 60, idle: int = 86400 * SECOND):
        self.interval, self.learn, self.threshold, self.sustain, self.max_step, self.levels, self.drop = interval, learn, threshold, sustain, max_step, levels, drop
        self.alpha, self.adapt, self.idle = alpha, adapt, idle
        self.last: int | None = None
        self._anew()

    def _anew(self) -> None:
        self.n, self.mean, self.dev, self.run, self.told = 0, 0.0, 0.0, 0, False

    def _step(self, x: float, floor: float) -> None:
        def bounded(move: float, of: float) -> float:
            most = self.max_step * max(of, floor)
            return min(max(move, -most), most)

        away = abs(x - self.mean)
        self.mean += bounded(self.alpha * (x - self.mean), self.mean)
        self.dev += bounded(self.alpha * (away - self.dev), self.dev)

    def update(self, x: float, metric: str) -> float | None:
        """The score if this interval fires, else None."""
        floor = FLOORS[metric]
        if self.n < self.learn:
            self.n += 1
            away = abs(x - self.mean) if self.n > 1 else 0.0
            self.mean += (x - self.mean) / self.n
            self.dev += (away - self.dev) / (self.n - 1) if self.n > 1 else 0.0
            return None
        score = (x - self.mean) / max(self.dev, floor)
        high = score >= self.threshold and x >= self.levels[metric]
        low = metric in self.drop and self.mean >= floor and x <= 0.1 * self.mean
        if not high and not low:
            self.run, self.told = 0, False
            self._step(x, floor)
            return None
        self.run += 1
        if self.run > self.adapt:
            self._step(x, floor)
        if self.run < self.sustain or self.told:
            return None
        self.told = True
        return score

    def add(self, row) -> Iterable[tuple]:
        out = []
        if self.last is not None:
            if row.t - self.last > self.idle:
                self._anew()
            else:  # intervals without any row
                for k in range(self.last + self.interval, row.t, self.interval):
                    if (score := self.update(0.0, row.metric)) is not None:
                        out.append((row.seq, k + self.interval, row.host, row.metric, 0.0, score))
        self.last = row.t
        if (score := self.update(row.x, row.metric)) is not None:
            out.append((row.seq, row.t + self.interval, row.host, row.metric, row.x, score))
        return out

    def end(self) -> Iterable[tuple]:
        return ()


def interval_metrics(packets: DataFrame, counted, fanout, interval: int, metrics: list[str]) -> DataFrame:
    """Values of each metric in each aligned interval (t is its start) that some packet starts and a later one ends: rates a second, but
    distinct addresses as they are; `fanout` is a host's own.

    counted and fanout are the conditions on packets that count; all packets move the clock.
    """
    start = F.col("t") - F.pmod(F.col("t") + F.lit(62_135_596_800 * SECOND % interval), F.lit(interval))
    rows = packets.select("seq", "src", "dst", start.alias("start"), counted.alias("hit"), fanout.alias("fan"), F.coalesce(F.nullif("wire_len", F.lit(0)), "capture_len").alias("size"),
                          F.coalesce((F.col("g") == "TCP") & (F.col("tcp_flags").bitwiseAND(18) == SYN), F.lit(False)).alias("conn"),
                          F.coalesce((F.col("app_protocol") == "dns") & F.exists("app_msgs", lambda m: (m["qname"] != "") & (m["is_response"] != "true")), F.lit(False)).alias("ask"))
    secs = interval / SECOND
    one = lambda c: F.sum((F.col("hit") & c).cast("double")) / secs
    whole = rows.groupBy("start").agg(
        F.max("seq").alias("seq"), one(F.lit(True)).alias("packets"), (F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0).cast("double")) / secs).alias("bytes"), one(F.col("conn")).alias("conns"),
        one(F.col("ask")).alias("dns"), F.count_distinct(F.when(F.col("hit"), F.col("dst"))).cast("double").alias("dsts"))
    wide = [m for m in metrics if m != "fanout"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in wide]) if wide else F.array().cast("array<struct<metric:string,x:double>>")
    out = whole.select("start", "seq", F.lit("").alias("host"), F.explode(pairs).alias("p")).select("start", "seq", "host", "p.*")
    if "fanout" in metrics:
        hosts = rows.where("hit and fan and dst is not null").groupBy("start", F.col("src").alias("host")).agg(F.max("seq").alias("seq"), F.count_distinct("dst").cast("double").alias("x"))
        out = out.unionByName(hosts.withColumn("metric", F.lit("fanout")))
    last = rows.agg(F.max("start").alias("__last"))  # one row: the interval that nothing has closed yet
    return out.crossJoin(F.broadcast(last)).where("start < __last").withColumnRenamed("start", "t").drop("__last")


def learned_baselines(metrics: DataFrame, interval: int, learn: int = 10, threshold: float = 4.0, sustain: int = 3, max_step: float = 0.2, levels: dict[str, float] | None = None, drop: set[str] = frozenset()) -> DataFrame:
    """Intervals at which a metric has stood out from what was learned of it for long enough."""
    return folded(metrics, ["metric", "host"], lambda: Learned(interval, learn, threshold, sustain, max_step, LEVELS | (levels or {}), drop), "seq long, t long, host string, metric string, x double, score double")


class _SlowFlow:
    """One connection to an HTTP port, from its client's side: the spans of time in which it is slow by each rule.

    rules: (sid, kind, min_age, seconds, min_rate, min_remaining), times in nanoseconds. Bytes are put in order by sequence number (early
    ones are held, at most 16 segments); a head may be 16 KiB; bodies of unknown length are never slow.
    """

    idle, hold, head_most = 120 * SECOND, 16, 16384

    def __init__(self, rules: list[tuple], ports: list[int]):
        self.rules, self.ports = rules, ports
        self.client: tuple | None = None
        self._closed()
        self.open: dict[int, tuple] = {}  # sid -> (enter, seq)

    def _closed(self) -> None:
        self.state, self.head, self.start, self.expected, self.seen = None, b"", 0, -1, 0
        self.data_t, self.zero_t, self.last, self.expect, self.held = None, None, None, None, {}

    def _feed(self, data: bytes, t: int) -> None:
        while data:
            if self.state == "body":
                left = self.expected - self.seen if self.expected >= 0 else len(data)
                took = min(left, len(data))
                self.seen, data = self.seen + took, data[took:]
                if self.expected >= 0 and self.seen >= self.expected:
                    self.state = None
                continue
            if self.state is None:
                self.state, self.head, self.start = "head", b"", t
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                if len(self.head) > self.head_most:
                    self.state, self.expected, self.seen = "body", -1, 0
                return
            lines, data = self.head[:at].lower().split(b"\r\n"), self.head[at + 4 :]
            given = {k.strip(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            n = given.get(b"content-length", b"")
            self.expected = int(n) if n.isdigit() else -1 if b"chunked" in given.get(b"transfer-encoding", b"") else 0
            self.seen, self.state = 0, "body" if self.expected else None

    def _spans(self, until: int) -> Iterator[tuple[int, int, int]]:
        """(sid, from, to) within the time from the last packet until the next one, in which nothing changes but the clock."""
        for sid, kind, age, seconds, rate, remaining in self.rules:
            low, high = self.last, until
            if kind == "slow_read":
                if self.zero_t is None:
                    continue
                low = max(low, self.zero_t + age + 1)
            else:
                if self.state != ("head" if kind == "slow_headers" else "body") or self.data_t is None:
                    continue
                low, high = max(low, self.start + age + 1), min(high, self.data_t + seconds + 1)
                if kind == "slow_body":
                    if self.expected - self.seen <= remaining or self.expected < 0:
                        continue
                    low = max(low, self.start + int(self.seen / rate * SECOND) + 1)
            if low < high:
                yield sid, low, high

    def _pass(self, until: int) -> list[tuple]:
        """Moves the clock on; returns the spans that have ended before `until`."""
        out = []
        now = {sid: (low, high) for sid, low, high in self._spans(until)}
        for sid in {*now, *self.open}:
            if sid in self.open and (sid not in now or now[sid][0] > self.last):
                out.append(self._row(sid, *self.open.pop(sid), self.last))
            if sid in now:
                enter = self.open.pop(sid, now[sid][0])
                enter = enter if isinstance(enter, tuple) else (enter, self.seq)
                if now[sid][1] < until:
                    out.append(self._row(sid, *enter, now[sid][1]))
                else:
                    self.open[sid] = enter
        return out

    def _row(self, sid: int, enter: int, seq: int, leave: int) -> tuple:
        return (sid, seq, enter, leave, *self.client)

    def _stop(self, t: int) -> list[tuple]:
        out = self._pass(min(t, self.last + self.idle)) if self.last is not None else []
        end = min(t, self.last + self.idle) if self.last is not None else t
        out += [self._row(sid, *x, end) for sid, x in self.open.items()]
        self.open = {}
        self._closed()
        return out

    def add(self, row) -> Iterable[tuple]:
        out = []
        if self.last is not None:
            out = self._stop(row.t) if row.t - self.last >= self.idle or row.tcp_flags & (FIN | RST) else self._pass(row.t)
        side = (row.src, row.sport, row.dst, row.dport)
        if self.client is None:
            mine = row.dport in self.ports if not row.tcp_flags & SYN else not row.tcp_flags & 16
            self.client = side if mine else (row.dst, row.dport, row.src, row.sport)
        if row.tcp_flags & (FIN | RST):
            return out
        self.last, self.seq = row.t, row.seq
        if side != self.client:
            return out
        data, at = bytes(row.payload or b""), row.tcp_seq
        if row.tcp_flags & SYN:
            self.expect, self.held = (at + 1) % (1 << 32), {}
        elif data:
            self.data_t = row.t
            self.expect = at if self.expect is None else self.expect
            self.held.setdefault(at, data)
            if len(self.held) > self.hold:
                self.expect = min(self.held, key=lambda s: (s - self.expect) % (1 << 32))
            for s in sorted(self.held, key=lambda s: (s - self.expect + (1 << 31)) % (1 << 32)):
                ahead = (s - self.expect + (1 << 31)) % (1 << 32) - (1 << 31)
                if ahead > 0:
                    break
                fresh = self.held.pop(s)[-ahead:]
                self.expect = (self.expect + len(fresh)) % (1 << 32)
                self._feed(fresh, row.t)
        zero = row.tcp_window == 0 and not row.tcp_flags & SYN
        self.zero_t = (self.zero_t if self.zero_t is not None else row.t) if zero else None
        return out

    def end(self) -> Iterable[tuple]:
        return self._stop(self.last + self.idle) if self.last is not None else ()


def slow_spans(packets: DataFrame, rules: list[tuple], ports: list[int]) -> DataFrame:
    """When each HTTP connection was slow by each rule: sid, seq, enter, leave and the addresses from the client's side.

    rules: (sid, kind, min_age, seconds, min_rate, min_remaining), in seconds and bytes; kinds slow_headers, slow_body and slow_read.
    """
    tcp = packets.where((F.col("g") == "TCP") & (F.col("sport").isin(ports) | F.col("dport").isin(ports)))
    slim = tcp.select("seq", "t", "src", "sport", "dst", "dport", "tcp_flags", "tcp_seq", "tcp_window", "payload").withColumn("conn", connection())
    exact = [(sid, kind, int(age * SECOND), int(secs * SECOND), rate, left) for sid, kind, age, secs, rate, left in rules]
    return folded(slim, ["conn"], lambda: _SlowFlow(exact, ports), "sid int, seq long, enter long, leave long, src string, sport int, dst string, dport int")
