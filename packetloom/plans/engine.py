"""A rule set over packets: firings of every rule, deduplicated into alerts and summaries.

All signature rules share one pass over the packets. Detectors get the relation they need (handshake outcomes, probes, DNS
messages ...), built once. Times are nanoseconds of the capture's clock.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITIES, entropy, standard_echo
from ..operators import correlate as C
from ..operators import detectors as D
from ..operators import feeds
from ..operators import handshake as H
from ..operators import predicates as P
from ..operators import primitives as K
from ..operators import stateful as S
from ..operators.streams import reassembled
from ..sources.decode import PORTS
from .rules import Rule, RuleSet, header, predicate, reads_streams, stages_of

SECOND = 1_000_000_000
WINDOW = 60 * SECOND
FIRING = ["sid", "seq", "t", "key", "src", "dst", "sport", "dport", "proto"]


def _items(text: str) -> list[str]:
    return [x.strip() for x in text.strip("[]").split(",") if x.strip()]


def _kept(df: DataFrame) -> DataFrame:
    """A relation that many rules read, computed once into the shared checkpoint folder; without one, by each rule anew."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


class Engine:
    def __init__(self, rules: RuleSet, packets: DataFrame, whitelist: str | None = None, feed_tables: dict[str, DataFrame] | None = None):
        self.rules, self.feed_tables, self.whitelist = rules, feed_tables or {}, whitelist
        #: app_data: the table comes from reassembled() already
        self.joined = "app_data" in packets.columns
        self.packets = packets if self.joined else packets.withColumns({"app_data": F.lit(None).cast("binary"), "stream_anomaly": F.lit(None).cast("string")})
        silent = [predicate(r) for r in rules.rules if r.action == "pass"] + ([P.address("src", whitelist)] if whitelist else [])
        #: silences alerts only: state is still fed by every packet
        self.silenced: Column = reduce(lambda a, b: a | b, silent) if silent else F.lit(False)

    @cached_property
    def heard(self) -> DataFrame:
        return self.packets.where(~self.silenced)

    @cached_property
    def told(self) -> DataFrame:
        """heard, with the messages of TCP connections put together."""
        return self.heard if self.joined else _kept(reassembled(self.packets)).where(~self.silenced)

    @cached_property
    def handshakes(self) -> DataFrame:
        return _kept(H.outcomes(self.packets)).withColumns({"g": F.lit("TCP"), "bad": F.col("outcome") != "complete"})

    @cached_property
    def dns(self) -> DataFrame:
        m = self.told.where("app_protocol = 'dns'").withColumn("m", F.explode("app_msgs"))
        return m.withColumns({"qname": F.col("m")["qname"], "response": F.col("m")["is_response"] == "true", "rcode": F.col("m")["rcode"], "id": F.col("m")["id"], "qtype": F.col("m")["qtype_name"]}).drop("m", "app_msgs")

    @cached_property
    def dns_events(self) -> DataFrame:
        """Responses by outcome, and questions opening and closing; silenced packets are part of the state and then left out."""
        m = self.packets.where("app_protocol = 'dns' and g = 'UDP'").select("seq", "t", "src", "dst", "sport", "dport", F.length("payload").cast("long").alias("size"), F.explode("app_msgs").alias("m"))
        m = m.withColumns({"response": F.col("m")["is_response"] == "true", "qname": F.coalesce(F.col("m")["qname"], F.lit("")), "qtype": F.col("m")["qtype"], "id": F.col("m")["id"]}).where("response is not null and id is not null")
        ends = {"client": F.when(F.col("response"), F.col("dst")).otherwise(F.col("src")), "server": F.when(F.col("response"), F.col("src")).otherwise(F.col("dst")), "cport": F.when(F.col("response"), F.col("dport")).otherwise(F.col("sport"))}
        return _kept(S.dns_transactions(m.withColumns(ends)))

    @cached_property
    def dns_responses(self) -> DataFrame:
        rows = self.packets.where("app_protocol = 'dns' and g = 'UDP'").select("seq", "g", "src", "dst", "sport", "dport", F.length("payload").cast("long").alias("size"), self.silenced.alias("quiet"))
        return self.dns_events.where("what = 'response'").join(rows, "seq").where("not quiet").drop("quiet")

    @cached_property
    def slow(self) -> DataFrame:
        """When connections were slow by each slow HTTP rule, while the capture lasts; one pass for all rules."""
        rules = [(r.sid, r.get("kind"), float(r.get("min_age", 10)), float(r.get("seconds", 30)), float(r.get("min_rate", 100)), int(r.get("min_remaining", 10240))) for r in self.rules.rules if r.detect == "slowloris"]
        spans = _kept(S.slow_spans(self.packets, rules, [p for p, name in PORTS.items() if name == "http"]))
        end = self.packets.agg(F.max("t").alias("__end"))  # one row
        kept = spans.withColumn("g", F.lit("TCP")).crossJoin(F.broadcast(end)).where("enter <= __end").drop("__end")
        return kept.where(~self.quiet_view)

    @cached_property
    def quiet_view(self) -> Column:
        """What whitelist and pass rules silence of rows that stand for a packet from a client: flows, opening SYNs, probes."""
        quiet = [header(r) for r in self.rules.rules if r.action == "pass" and not r.options] + ([P.address("src", self.whitelist)] if self.whitelist else [])
        return F.coalesce(reduce(lambda a, b: a | b, quiet), F.lit(False)) if quiet else F.lit(False)

    @cached_property
    def probes(self) -> DataFrame:
        failed = self.handshakes.where("bad").select("seq", "t", "src", "sport", "dst", "dport", "g")
        odd = self.packets.where((F.col("g") == "TCP") & (F.col("tcp_flags").bitwiseAND(63).isin(0, 1, 41))).select("seq", "t", "src", "sport", "dst", "dport", "g")
        refused = self.packets.where("(icmp_type = 3 and icmp_code = 3 or icmp_type = 1 and icmp_code = 4) and quoted_proto = 17").select("seq", "t", F.col("quoted_src").alias("src"), F.col("quoted_sport").alias("sport"), F.col("quoted_dst").alias("dst"), F.col("quoted_dport").alias("dport"), F.lit("UDP").alias("g"))
        return failed.unionByName(odd).unionByName(refused)

    def firings(self) -> DataFrame:
        """sid, seq, t, key (of deduplication) and the addresses of every firing of every rule."""
        alerts = [r for r in self.rules.rules if r.action == "alert" and r.detect != "incident"]
        plain = [r for r in alerts if not r.detect and not any(k.endswith("_feed") or k == "detection_filter" for k, _ in r.options)]
        out = []
        if plain:  # one pass for all of them
            seen = self.told if any(map(reads_streams, plain)) else self.heard
            hit = seen.withColumn("sid", F.explode(P.multi_rule({r.sid: predicate(r) for r in plain})))
            out.append(self._out(hit, F.col("sid"), [F.col("src"), F.col("dst")]))
        for r in alerts:
            if r not in plain and (rows := self._special(r)) is not None:
                out.append(rows)
        if not out:  # no rule applies, such as when feeds or bindings are missing
            return self._out(self.packets.where("false"), F.lit(0), [F.col("src")])
        return reduce(DataFrame.unionByName, out)

    def _out(self, rows: DataFrame, sid: Column, key: list[Column]) -> DataFrame:
        have = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string" if c in ("src", "dst") else "int") for c in ("src", "dst", "sport", "dport")}
        proto = F.col("g") if "g" in rows.columns else F.lit("")
        return rows.select(sid.cast("int").alias("sid"), "seq", "t", F.concat_ws("|", *[k.cast("string") for k in key]).alias("key"), *[c.alias(n) for n, c in have.items()], proto.alias("proto"))

    def _special(self, r: Rule) -> DataFrame | None:
        sid, span = F.lit(r.sid), int(r.get("seconds", 0)) * SECOND
        n = int(r.get("count", 1))
        side = "dst" if r.get("track") == "by_dst" else "src"
        fits = (self.told if reads_streams(r) else self.heard).where(predicate(r)) if not r.detect else None
        if given := r.get("detection_filter"):
            words = dict(x.split() for x in given.split(","))
            track = words["track"].removeprefix("by_")
            rows = D.detection_filter(fits, track, int(words["count"]), int(words["seconds"]) * SECOND)
            return self._out(rows, sid, [F.col(track)])
        for kind in ("ip_feed", "domain_feed", "ja3_feed"):
            if given := r.get(kind):
                return self._feed(r, fits, kind, given)
        rows = self.packets.where(header(r))
        audible = rows.where(~self.silenced)
        view = header(r) & ~self.quiet_view  # of derived rows: in the rule's scope, and not silenced
        match r.detect:
            case "syn_flood":
                hit = D.syn_flood(self.handshakes.where(view), side, n, span, float(r.get("min_incomplete_ratio", 0.8)), int(r.get("max_distinct_ports", 5)), F.col("bad"))
                return self._out(hit, sid, [F.col(side)])
            case "port_scan":
                probes = self.probes.where(view).withColumn("target", F.concat_ws("/", F.col("dport").cast("string"), "g"))
                return self._out(D.distinct_scan(probes, ["src"], "target", int(r.get("distinct_ports")), span), sid, [F.col("src")])
            case "host_sweep":
                return self._out(D.distinct_scan(self.probes.where(view), ["src", "dport", "g"], "dst", int(r.get("distinct_hosts")), span), sid, [F.col("src"), F.col("dport")])
            case "ping_sweep":
                pings = audible.where("g = 'ICMP' and icmp_type in (8, 128)")
                return self._out(D.distinct_scan(pings, ["src"], "dst", int(r.get("distinct_hosts")), span), sid, [F.col("src")])
            case "udp_flood":
                size = F.length("payload").cast("long") + 8 if r.get("metric") == "bytes" else F.lit(1).cast("long")
                # who spoke first in a flow (by_dst: between two addresses), until it has been idle for 30 s; the other one replies
                pair = H.connection() if side == "src" else F.concat_ws("~", F.least("src", "dst"), F.greatest("src", "dst"))
                udp = K.sessions(self.packets.where("g = 'UDP'").withColumns({"pair": pair, "quiet": self.silenced}), ["pair"], 30 * SECOND)
                opener = F.first("src").over(Window.partitionBy("pair", "session").orderBy("t", "seq"))
                udp = udp.withColumn("reply", F.col("src") != opener).where(F.col("reply") | ~F.col("quiet") & header(r))
                udp = udp.withColumn("addr", F.when(F.col("reply"), F.col("dst" if side == "src" else "src")).otherwise(F.col(side)))
                udp = udp.select("seq", "t", "g", "src", "dst", "sport", "dport", "payload", "reply", "addr")
                hit = D.rate_flood(udp, ["addr"], size, span, n, F.col("reply"), float(r.get("max_reply_ratio", 0.02)))
                return self._out(hit, sid, [F.col("addr")])
            case "icmp_flood":
                icmp = audible.where("g = 'ICMP'")
                if r.get("kind") == "echo":
                    icmp = icmp.where("icmp_type in (8, 128)")
                elif r.get("kind") == "unsolicited_reply":
                    side = "dst"
                    pair = F.least("src", "dst"), F.greatest("src", "dst")
                    both = self.packets.where("g = 'ICMP'").withColumns({"a": pair[0], "b": pair[1]})
                    icmp = D.unsolicited(both, ["a", "b", "echo_id"], F.col("icmp_type").isin(8, 128), F.col("icmp_type").isin(0, 129), 10 * SECOND).where(header(r)).where(~self.silenced)
                else:
                    side = "dst"
                    icmp = icmp.where("icmp_type in (3, 4, 5, 11, 12)")
                return self._out(D.rate_flood(icmp, [side], F.lit(1).cast("long"), span, n), sid, [F.col(side)])
            case "frag_attack":
                frags = audible.where("frag_offset > 0 or more_fragments").withColumns({"a": F.col("frag_offset").cast("long"), "z": F.col("frag_offset") + F.col("frag_len")})
                if r.get("kind") == "overlap":
                    frags = D.fragment_overlaps(frags, ["src", "dst", "ip_proto", "ip_id"], "a", "z", 30 * SECOND)
                elif r.get("kind") == "tiny":
                    # a first fragment that splits the transport header, or any but the last one under min_size
                    least = F.when(F.col("ip_proto") == 6, 20).when(F.col("ip_proto") == 17, 8).otherwise(0)
                    frags = frags.where((F.col("frag_offset") == 0) & (F.col("frag_len") < least) | F.col("more_fragments") & (F.col("frag_len") < int(r.get("min_size", 256))))
                elif r.get("kind") == "oversize":
                    frags = frags.where(D.oversize_fragment(F.col("frag_offset"), F.col("frag_len")))
                else:
                    frags = K.window_hits(S.incomplete_datagrams(audible), ["src"], n, span)
                return self._out(frags, sid, [F.col("src")])
            case "ttl_anomaly":
                sampled = audible
                if r.get("scope") == "external" and (home := self.rules.variables.get("HOME_NET")):
                    sampled = audible.where(~P.address("src", home))
                odd = S.hop_anomalies(sampled, self.handshakes, int(r.get("min_samples", 10)), int(r.get("max_hop_diff", 3)))
                return self._out(K.window_hits(odd, ["src"], n, span), sid, [F.col("src")])
            case "dns_spoof":
                kind = r.get("kind")
                if kind == "id_race":
                    heard = self.dns_responses.where(header(r)).select("seq", "g", "src", "dst", "sport", "dport").distinct()
                    ids = S.asked_names(self.dns_events).join(heard, "seq")
                    hit = D.distinct_scan(ids, ["client", "server", "qname"], "id", n, span)
                elif kind == "qname_mismatch":
                    hit = self.dns_responses.where(header(r)).where("outcome = 'mismatch'")
                else:
                    hit = K.window_hits(self.dns_responses.where(header(r)).where("outcome = 'unsolicited'"), ["client"], n, span)
                return self._out(hit, sid, [F.col("client")])
            case "dns_amplification":
                free = F.when(F.col("outcome") == "matched", 0).otherwise(F.col("size")).cast("long")
                hit = D.amplification(self.dns_responses.where(header(r)), ["client"], F.col("size"), F.coalesce("query_size", F.lit(0)), span, int(r.get("min_bytes")), float(r.get("min_ratio", 10)), unmatched=free)
                return self._out(hit, sid, [F.col("client")])
            case "slowloris":
                mine = self.slow.where(F.col("sid") == r.sid).where(header(r))
                entered = D.concurrent(mine, side, "enter", "leave", n).select("seq", "t")
                return self._out(mine.withColumnRenamed("enter", "t").join(entered, ["seq", "t"]).drop("sid"), sid, [F.col(side)])
            case "arp_spoof":
                return self._arp(r, sid, n, span)
            case "dns_tunnel":
                asked = self.dns.where(header(r)).where(~F.col("response") & F.col("qname").isNotNull())
                if allow := r.get("allow"):
                    asked = asked.where(~P.domain(F.col("qname"), _items(allow)))
                if r.get("kind") == "txt":
                    return self._out(D.detection_filter(asked.where("qtype in ('TXT', 'NULL')"), "src", n, span), sid, [F.col("src"), F.col("dst")])
                hit = D.tunnel_subdomains(asked, ["src", "dst"], "qname", n, span, float(r.get("min_entropy", 3.5)), float(r.get("min_length", 50)))
                return self._out(hit, sid, [F.col("src"), F.col("dst"), F.col("domain")])
            case "dns_nxdomain_burst":
                none = self.dns.where(header(r)).where(F.col("response") & (F.col("rcode") == "3") & F.col("qname").isNotNull())
                return self._out(D.nxdomain_burst(none, "dst", "qname", n, span, float(r.get("min_entropy", 3.0))), sid, [F.col("dst")])
            case "beacon":
                return self._beacon(r, self.told if r.get("allow") else audible, sid)
            case "baseline":
                return self._baseline(r, sid)
            case "icmp_tunnel":
                text = F.decode("payload", "ISO-8859-1")
                echoes = audible.where("g = 'ICMP' and icmp_type in (0, 8)").where(~standard_echo(F.col("payload"))).withColumns({"size": F.length("payload"), "h": entropy(text)})
                return self._out(D.tunnel_sizes(echoes, ["src", "dst"], "size", "h", n, span), sid, [F.col("src"), F.col("dst")])
        return None

    def _beacon(self, r: Rule, rows: DataFrame, sid: Column) -> DataFrame:
        skip = (F.col("g") == "UDP") & (F.col("dport") == 53) | P.port("dport", r.get("allow_ports", "123"))
        if addrs := r.get("allow_addrs"):
            skip = skip | P.address("dst", addrs)
        lean = rows.where("g in ('TCP', 'UDP')").where(header(r)).where(~skip)
        lean = lean.select("seq", "t", "g", "src", "dst", "sport", "dport", "tcp_flags", "tcp_seq", "app_msgs")
        syn = lean.where((F.col("g") == "TCP") & (F.col("tcp_flags").bitwiseAND(18) == 2)).drop("app_msgs")
        syn = D.flow_starts(syn, ["src", "sport", "dst", "dport", "tcp_seq"], 60 * SECOND)
        talk = D.flow_starts(lean.where("g = 'UDP'").drop("app_msgs").withColumn("conn", H.connection()), ["conn"], 30 * SECOND).drop("conn")
        key = ["src", "dst", "dport", "g"]
        starts = K.sessions(syn.unionByName(talk), key, 6 * 3600 * SECOND)
        jitter = float(r.get("jitter", 0.25))
        gaps = [int(float(r.get(k, d)) * SECOND) for k, d in (("min_interval", 10), ("max_interval", 3600))]
        hit = D.beacons(starts, [*key, "session"], int(r.get("min_events", 10)), streak=int(r.get("persistence", 4)), min_share=float(r.get("min_fraction", 0.7)), low_gap=gaps[0], high_gap=gaps[1], low=1 - jitter, high=1 + jitter)
        if allow := r.get("allow"):  # destinations that have been named as an allowed domain by then
            names = lean.withColumn("m", F.explode("app_msgs")).select(*key, F.col("t").alias("named_t"), F.coalesce(F.col("m")["sni"], F.regexp_replace(F.col("m")["host"], r":[0-9]*$", "")).alias("name"))
            named = names.where(P.domain(F.col("name"), _items(allow))).groupBy(*key).agg(F.min("named_t").alias("named_t"))
            hit = hit.join(named, key, "left").where(F.col("named_t").isNull() | (F.col("named_t") > F.col("t")))
        return self._out(hit, sid, [F.col("src"), F.col("dst"), F.col("dport")])

    def _baseline(self, r: Rule, sid: Column) -> DataFrame:
        interval = int(r.get("interval", 60)) * SECOND
        metrics = [m.strip() for m in r.get("metrics", ",".join(S.FLOORS)).split(",")]
        levels = {k.strip(): float(v) for k, v in (x.split("=") for x in r.get("min_level", "").split(",") if x)}
        values = S.interval_metrics(self.packets, ~self.silenced & header(r), P.address("src", r.src), interval, metrics)
        hit = S.learned_baselines(values, interval, int(r.get("learn_intervals", 10)), float(r.get("threshold", 4)), int(r.get("sustain", 3)), float(r.get("max_step", 0.2)), levels, {x.strip() for x in r.get("drop", "").split(",") if x})
        return self._out(hit.withColumns({"src": F.nullif("host", F.lit("")), "dst": F.lit(None).cast("string")}), sid, [F.col("host"), F.col("metric")])

    def _arp(self, r: Rule, sid: Column, n: int, span: int) -> DataFrame | None:
        arp = self.heard.where(header(r))
        claims = arp.where("src <> '0.0.0.0'").withColumnRenamed("arp_sender_mac", "mac")
        hours = 4 * 3600 * SECOND
        kind = r.get("kind")
        if kind == "static_violation":
            bound = F.create_map(*[F.lit(x) for kv in self.rules.bindings.items() for x in kv]) if self.rules.bindings else None
            return self._out(claims.where(bound[F.col("src")] != F.col("mac")), sid, [F.col("src")]) if bound is not None else None
        if kind == "mac_change":
            return self._out(D.binding_changes(claims, "src", "mac", hours), sid, [F.col("src")])
        if kind == "flip_flop":
            return self._out(D.flip_flops(claims, "src", "mac", hours, n, span), sid, [F.col("src")])
        if kind == "unsolicited_reply":
            pair = {"a": F.when(F.col("arp_op") == 1, F.col("src")).otherwise(F.col("dst")), "b": F.when(F.col("arp_op") == 1, F.col("dst")).otherwise(F.col("src"))}
            # who asked is known from every packet, silenced or not
            all_ = self.packets.where("g = 'ARP' and src <> '0.0.0.0' and arp_op in (1, 2)")
            alone = D.unsolicited(all_.where("src <> dst").withColumns(pair), ["a", "b"], F.col("arp_op") == 1, F.col("arp_op") == 2, 5 * SECOND)
            alone = alone.select(all_.columns).where(header(r)).where(~self.silenced)
            # of announcements, asked for by nobody, the first two of an address and MAC within the time are free
            claim = ["src", "arp_sender_mac"]
            free = K.window_hits(all_.where("src = dst").where(header(r)).where(~self.silenced), claim, 3, span)
            return self._out(K.window_hits(alone.unionByName(free.select(all_.columns)), claim, n, span), sid, [F.col("src"), F.col("arp_sender_mac")])
        if kind == "multi_ip":
            return self._out(D.distinct_scan(claims, ["mac"], "src", n, span), sid, [F.col("mac")])
        if kind == "mismatch":
            return self._out(arp.where("arp_sender_mac <> eth_src"), sid, [F.col("src"), F.col("arp_sender_mac")])
        return self._out(arp.where("arp_sender_mac in ('ff:ff:ff:ff:ff:ff', '00:00:00:00:00:00') or conv(substring(arp_sender_mac, 2, 1), 16, 10) % 2 = 1"), sid, [F.col("arp_sender_mac")])

    def _feed(self, r: Rule, rows: DataFrame, kind: str, given: str) -> DataFrame | None:
        name, *more = given.split(",")
        table = self.feed_tables.get(name)
        if table is None:
            return None
        sid = F.lit(r.sid)
        lean = rows.select("seq", "t", "g", "src", "dst", "sport", "dport", "app_msgs")
        if kind == "ip_feed":
            lean = lean.drop("app_msgs")
            sides = lean.withColumns({"ip": F.col("src"), "peer": F.col("dst")}).unionAll(lean.withColumns({"ip": F.col("dst"), "peer": F.col("src")}))
            hit = feeds.ip_feed_join(sides, "ip", table).dropDuplicates(["seq"])
            return self._out(hit, sid, [F.col("ip"), F.col("peer")])
        keys = more if kind == "domain_feed" and more else ["qname", "sni", "host"] if kind == "domain_feed" else ["ja3_hash"]
        names = lean.withColumn("m", F.explode("app_msgs")).drop("app_msgs").withColumn("name", F.explode(F.filter(F.array(*[F.regexp_replace(F.col("m")[k], r":[0-9]*$", "") for k in keys]), lambda x: x.isNotNull()))).drop("m")
        if kind == "domain_feed":
            hit = feeds.domain_feed_join(names, "name", table).dropDuplicates(["seq"])
        else:
            hit = feeds.hash_feed_join(names, F.col("name"), table)
            if more:
                hit = hit.where("label <> ''" if more[0] == "labeled" else "coalesce(label, '') = ''")
        return self._out(hit, sid, [F.col("src"), F.col("dst")])

    def alerts(self) -> DataFrame:
        """Alerts and summaries: the first firing of each key opens a window of 60 s, the others are counted."""
        meta = self.packets.sparkSession.createDataFrame([(r.sid, r.rev, r.msg, r.severity, r.category) for r in self.rules.rules], "sid int, rev int, msg string, severity string, category string")
        windows = K.dedup_windows(self.firings(), ["sid", "key"], WINDOW, payload=["src", "dst", "sport", "dport", "proto"])
        end = self.packets.agg(F.max("t").alias("end_t"))
        closed = K.summaries(windows.crossJoin(F.broadcast(end)), WINDOW, F.col("end_t")).withColumns({"kind": F.lit("summary"), "time": F.col("close_t")})
        first = windows.withColumns({"kind": F.lit("alert"), "time": F.col("first_t"), "last_t": F.col("first_t"), "n": F.lit(1).cast("long")})
        both = first.unionByName(closed.select(*first.columns))
        return both.join(F.broadcast(meta), "sid").select("kind", "time", F.col("first_t").alias("first_seen"), F.col("last_t").alias("last_seen"), F.col("n").alias("count"), "sid", "rev", "msg", "severity", "category", "proto", "src", "sport", "dst", "dport")

    def attributed(self, alerts: DataFrame) -> DataFrame:
        """New alerts as the correlation sees them: seq, t, src, dst, stage (-1: none), weight, and whether the source is sure.

        It is for beacons, slow HTTP, DNS tunnels over TCP, application rules on TCP, and signatures on TCP connections that have
        completed their handshake. ARP names its actor by MAC, so its alerts are left to the victim's side.
        """
        app = {"app_proto", "stream_anomaly", "app_field", "app_reason", "app_content", "app_domain", "regex"}
        sure = [r.sid for r in self.rules.rules if r.detect in ("beacon", "slowloris")]
        over_tcp = [r.sid for r in self.rules.rules if r.detect in ("dns_tunnel", "dns_nxdomain_burst") or not r.detect and any(k in app for k, _ in r.options)]
        plain = [r.sid for r in self.rules.rules if not r.detect]
        stage = F.coalesce(*[F.when(F.col("category") == c, k) for c, k in self.rules.stages.items()], F.lit(-1))
        weight = F.coalesce(*[F.when(F.col("severity") == x, k + 1) for k, x in enumerate(SEVERITIES)])
        arp = F.col("proto") == "ARP"
        burst = F.col("sid").isin([r.sid for r in self.rules.rules if r.detect == "dns_nxdomain_burst"] or [-1])
        # an NXDOMAIN burst is its client's doing, and names no target
        who = F.when(burst, F.col("dst")).when(~arp, F.col("src"))
        rows = alerts.where("kind = 'alert'").select("sid", F.col("time").alias("t"), who.alias("src"), F.when(~burst, F.col("dst")).alias("dst"), "sport", "dport", "proto", stage.alias("stage"), weight.cast("long").alias("weight"))
        rows = rows.withColumn("conn", H.connection())
        known = self.handshakes.where("outcome = 'complete'").withColumn("conn", H.connection()).groupBy("conn").agg(F.min("t").alias("done_t"))
        rows = rows.join(known, "conn", "left")
        tcp = F.col("proto") == "TCP"
        reliable = F.col("sid").isin(sure or [-1]) | tcp & F.col("sid").isin(over_tcp or [-1]) | tcp & F.col("sid").isin(plain or [-1]) & (F.col("done_t") <= F.col("t"))
        return rows.withColumns({"reliable": F.coalesce(reliable & F.col("src").isNotNull(), F.lit(False)), "seq": F.col("sid").cast("long")})

    def incidents(self, alerts: DataFrame | None = None) -> DataFrame:
        """Incidents of the rule set's incident rules over its alerts, and updates when a chain grows."""
        if alerts is None:
            alerts = _kept(self.alerts())
        seen = self.attributed(alerts)
        out = []
        for r in self.rules.rules:
            if r.detect != "incident":
                continue
            kind, start, end = r.get("kind"), stages_of(r, "from", self.rules), stages_of(r, "to", self.rules)
            if kind == "multi_stage":
                rows = C.chain_states(seen, start, int(r.get("first_window", 86400)) * SECOND, int(r.get("window", 3600)) * SECOND, int(r.get("min_stages", 2)))
                rows = rows.withColumn("factor", F.size("stages")).select("src", "dst", "t", "kind", "stages", "severity", "extra", "factor")
                victim = "dst"
            elif kind == "compromised_host":
                both = C.contributions(seen).where("role = 'victim' or reliable")
                hit = C.compromised_hosts(both, start, end, int(r.get("window", 86400)) * SECOND)
                stages = F.array_sort(F.array_distinct(F.array(*[F.lit(x) for x in start[:1]], F.col("stage"))))
                rows = hit.groupBy("host").agg(F.min_by(F.struct("t", stages.alias("stages"), "weight", "exploit_t"), F.struct("t", "seq")).alias("h"))
                by = both.where((F.col("role") == "victim") & F.col("stage").isin(start)).select("host", F.col("t").alias("exploit_t"), "peer").groupBy("host", "exploit_t").agg(F.min("peer").alias("dst"))
                rows = rows.select("host", "h.*").join(by, ["host", "exploit_t"]).select(F.col("host").alias("src"), "dst", "t", F.lit("incident").alias("kind"), "stages", F.lit("critical").alias("severity"), F.col("weight").alias("extra"), F.size("stages").alias("factor"))
                victim = "src"
            else:
                syn = self.heard.where((F.col("g") == "TCP") & (F.col("tcp_flags").bitwiseAND(18) == 2)).select("t", "seq", "src", "dst")
                hits = C.callbacks(syn, seen.where("reliable").where(F.col("stage").isin(start)), int(r.get("window", 120)) * SECOND)
                rows = hits.groupBy(F.col("host").alias("src"), F.col("peer").alias("dst")).agg(F.min("t").alias("t"))
                rows = rows.select("src", "dst", "t", F.lit("incident").alias("kind"), F.array(*[F.lit(x) for x in start[:1]]).alias("stages"), F.lit("critical").alias("severity"), F.lit(0).cast("long").alias("extra"), F.lit(2).alias("factor"))
                victim = "src"
            fits = P.address("src", r.src) & P.address("dst", r.dst) if kind != "callback" else P.address("dst", r.src) & P.address("src", r.dst)
            rows = C.victim_weight(rows.where(fits), seen, victim).withColumn("score", F.col("factor") * (F.col("base") + F.col("extra")))
            out.append(rows.select("kind", F.col("t").alias("time"), F.lit(r.sid).alias("sid"), F.lit(kind).alias("incident_kind"), F.lit(r.msg).alias("msg"), "severity", "stages", "score", "src", "dst"))
        return reduce(DataFrame.unionByName, out)
