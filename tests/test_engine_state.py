"""Detectors that need state of their own, on made-up captures."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import packets as T  # noqa: E402

from packetloom.plans import rules as R  # noqa: E402
from packetloom.plans.engine import Engine  # noqa: E402
from packetloom.sources import pcap  # noqa: E402

S = 10**9


def fired(spark, tmp_path, frames, rules, whitelist=None):
    """{sid: keys that fired} of a capture of (seconds, frame)."""
    (tmp_path / "x.pcap").write_bytes(T.pcap([(int(t * S), f) for t, f in sorted(frames, key=lambda x: x[0])]))
    rows = pcap.packets(pcap.read_frames(spark, f"{tmp_path}/x.pcap")).cache()
    out: dict[int, set] = {}
    for r in Engine(R.parse(rules), rows, whitelist).firings().collect():
        out.setdefault(r.sid, set()).add(r.key)
    return out


def test_dns_state(spark, tmp_path):
    ask = lambda t, client, ident, name: (t, T.udp(client, 5000, "192.0.2.53", 53, T.query(ident, name)))
    answer = lambda t, client, ident, name, port=5000: (t, T.udp("192.0.2.53", 53, client, port, T.query(ident, name, response=True)))
    frames = [ask(1, "10.0.0.1", 7, "a.example"), answer(1.1, "10.0.0.1", 7, "a.example")]  # as it should be
    frames += [ask(2, "10.0.0.2", 7, "a.example"), answer(2.1, "10.0.0.2", 7, "b.example")]  # another question
    frames += [answer(3 + i / 10, "10.0.0.3", i, "c.example") for i in range(5)]  # nobody asked
    frames += [ask(4, "10.0.0.4", 99, "d.example")] + [answer(4.1 + i / 10, "10.0.0.4", i, "d.example") for i in range(5)]  # guessed ids
    frames += [ask(20, "10.0.0.5", 1, "e.example")] + [answer(31 + i / 10, "10.0.0.5", 1, "e.example") for i in range(4)]  # too late, one short
    got = fired(spark, tmp_path, frames, """
alert ip any any -> any any (msg:"u"; detect:dns_spoof; kind:unsolicited_response; count:5; seconds:10; sid:1;)
alert ip any any -> any any (msg:"r"; detect:dns_spoof; kind:id_race; count:5; seconds:10; sid:2;)
alert ip any any -> any any (msg:"q"; detect:dns_spoof; kind:qname_mismatch; sid:3;)
alert ip any any -> any any (msg:"a"; detect:dns_amplification; min_bytes:120; seconds:5; min_ratio:10; sid:4;)
""")
    assert got == {1: {"10.0.0.3", "10.0.0.4"}, 2: {"10.0.0.4"}, 3: {"10.0.0.2"}, 4: {"10.0.0.3", "10.0.0.4"}}


def test_ttl_and_fragments(spark, tmp_path):
    frames = [(i / 10, T.ping("10.0.0.1", "192.0.2.1", ttl=60)) for i in range(10)]
    frames += [(2 + i / 10, T.ping("10.0.0.1", "192.0.2.1", ttl=61)) for i in range(3)] + [(3 + i / 10, T.ping("10.0.0.1", "192.0.2.1", ttl=40)) for i in range(3)]
    frames += [(i / 10, T.ping("10.0.0.2", "192.0.2.1", ttl=60)) for i in range(10)]
    for i in range(3):  # connections that complete are samples only
        a = ("10.0.0.2", 4000 + i, "192.0.2.1", 80)
        frames += [(5 + i, T.tcp(*a, "S", 1, ttl=40)), (5.1 + i, T.tcp("192.0.2.1", 80, *a[:2], "SA", 9, 2)), (5.2 + i, T.tcp(*a, "A", 2, 10, ttl=40))]
    for i in range(4):  # no last fragment; and whole datagrams
        frames += [(40 + i, T.ip4(17, "10.0.0.3", "192.0.2.1", bytes(512), ident=i, more=True))]
        frames += [(40 + i, T.ip4(17, "10.0.0.4", "192.0.2.1", bytes(512), ident=i, more=True)), (40.5 + i, T.ip4(17, "10.0.0.4", "192.0.2.1", bytes(88), ident=i, frag=512))]
    frames += [(50, T.ip4(6, "10.0.0.5", "192.0.2.1", bytes(64), ident=9, more=True))]
    got = fired(spark, tmp_path, frames, """
alert ip any any -> any any (msg:"t"; detect:ttl_anomaly; count:3; seconds:60; min_samples:10; max_hop_diff:3; sid:1;)
alert ip any any -> any any (msg:"f"; detect:frag_attack; kind:flood; count:4; seconds:30; sid:2;)
alert ip any any -> any any (msg:"y"; detect:frag_attack; kind:tiny; min_size:256; sid:3;)
""")
    assert got == {1: {"10.0.0.1"}, 2: {"10.0.0.3"}, 3: {"10.0.0.5"}}


def test_beacon_baseline_and_replies(spark, tmp_path):
    frames = []
    for i in range(44):  # one start a minute; the second host's destination is allowed
        for k, host in enumerate(("10.0.0.1", "10.0.0.2")):
            frames.append((60 * i + 1, T.tcp(host, 2000 + i, "198.51.100.9", 443, "S", i)))
            if k:
                frames.append((60 * i + 2, T.tcp(host, 2000 + i, "198.51.100.9", 443, "PA", i + 1, 1, T.hello("cdn.ok.example"))))
    for i in range(44):  # as many irregular ones
        frames.append((60 * i + (i * i * 7) % 50, T.tcp("10.0.0.3", 2000 + i, "198.51.100.9", 80 + i % 2 * 8000, "S", i)))
    frames += [(40 * 60 + i / 400, T.ping("10.0.0.4", f"203.0.{i // 250}.{i % 250 + 1}")) for i in range(400)]  # a burst to many addresses
    for i in range(100):  # answered, and not answered
        frames += [(5 + i / 100, T.udp("10.0.0.5", 7, "192.0.2.8", 9)), (5.001 + i / 100, T.udp("192.0.2.8", 9, "10.0.0.5", 7)), (5 + i / 100, T.udp("10.0.0.6", 7, "192.0.2.8", 9))]
    got = fired(spark, tmp_path, frames, """
alert ip any any -> any any (msg:"b"; detect:beacon; allow:[ok.example]; sid:1;)
alert ip any any -> any any (msg:"l"; detect:baseline; metrics:dsts; sustain:1; sid:2;)
alert udp any any -> any any (msg:"u"; detect:udp_flood; track:by_src; count:100; seconds:5; sid:3;)
""")
    assert got == {1: {"10.0.0.1|198.51.100.9|443"}, 2: {"|dsts"}, 3: {"10.0.0.6"}}


def test_learned():
    from packetloom.operators.stateful import Learned

    model = Learned(60, 5, 4.0, 2, 0.2, {"packets": 10.0}, {"packets"})
    values = [100, 110, 90, 100, 100] + [100, 300, 300, 300, 100, 300, 300] + [100, 5, 5]
    fired = [i for i, x in enumerate(values) if model.update(float(x), "packets") is not None]
    assert fired == [7, 11, 14]


def test_incidents(spark, tmp_path):
    x, y, c2 = "203.0.113.5", "10.0.0.9", "198.51.100.7"

    def talk(t, a, b, port, data, sport=5000):
        return [(t, T.tcp(a, sport, b, port, "S", 10)), (t + 0.01, T.tcp(b, port, a, sport, "SA", 70, 11)), (t + 0.02, T.tcp(a, sport, b, port, "A", 11, 71)), (t + 0.03, T.tcp(a, sport, b, port, "PA", 11, 71, data))]

    frames = [(1 + p / 50, T.tcp(x, 40000, y, p, "S", p)) for p in range(1, 26)]  # recon
    frames += talk(60, x, y, 80, b"GET /evil HTTP/1.1\r\nHost: a\r\n\r\n")  # exploit
    frames += talk(90, y, x, 4444, b"shell")  # calls back
    frames += talk(120, y, c2, 8081, b"C2CHECKIN")  # the victim's own later stage
    frames += talk(130, "10.0.0.8", c2, 8081, b"C2CHECKIN", 6000)  # never a victim
    (tmp_path / "x.pcap").write_bytes(T.pcap([(int(t * S), f) for t, f in sorted(frames, key=lambda z: z[0])]))
    rows = pcap.packets(pcap.read_frames(spark, f"{tmp_path}/x.pcap")).cache()
    rules = R.parse("""
stage recon recon
stage exploit web
stage c2 malware
alert ip any any -> any any (msg:"scan"; detect:port_scan; distinct_ports:20; seconds:10; sid:1; category:recon;)
alert tcp any any -> any any (msg:"evil"; content:"/evil"; sid:2; severity:high; category:web;)
alert tcp any any -> any any (msg:"c2"; content:"C2CHECKIN"; sid:3; severity:critical; category:malware;)
alert ip any any -> any any (msg:"m"; detect:incident; kind:multi_stage; sid:11;)
alert ip any any -> any any (msg:"h"; detect:incident; kind:compromised_host; sid:12;)
alert ip any any -> any any (msg:"b"; detect:incident; kind:callback; sid:13;)
""")
    got = sorted((r.sid, r.kind, r.src, r.dst, r.severity, r.score) for r in Engine(rules, rows).incidents().collect())
    # medium 2 (scan) and high 3 on the victim; its own critical alert adds 4
    assert got == [(11, "incident", x, y, "high", 10), (11, "incident_update", x, y, "critical", 27), (12, "incident", y, x, "critical", 18), (13, "incident", y, x, "critical", 10)]


def test_incident_rules():
    import pytest

    for options in ("kind:odd", "kind:callback; to:c2", "kind:multi_stage; min_stages:4", "kind:compromised_host; from:c2", "kind:multi_stage; from:nope"):
        with pytest.raises(R.RuleErrors):
            R.parse(f"stage recon a\nstage exploit b\nstage c2 c\nalert ip any any -> any any (detect:incident; {options}; sid:1;)")


def test_slow_http(spark, tmp_path):
    server = ("192.0.2.1", 80)
    post = b"POST / HTTP/1.1\r\nContent-Length: 100000\r\n\r\n"

    def flow(client, k, parts, window=65535):
        a = (client, 4000 + k, *server)
        out, at = [(k / 100, T.tcp(*a, "S", 0))], 1
        for t, data in parts:
            out.append((t + k / 100, T.tcp(*a, "PA", at, 1, data, window=window)))
            at += len(data)
        return out

    frames = [(60, T.ping("10.9.9.9", "192.0.2.1"))]  # the clock goes on
    for k in range(3):
        frames += flow("10.0.0.1", k, [(1, b"GET / HTTP/1.1\r\n"), (8, b"X: 1\r\n"), (16, b"X: 2\r\n")])  # heads that don't end
        frames += flow("10.0.0.2", k, [(1, b"GET / HTTP/1.1\r\n"), (8, b"X: 1\r\n\r\n")])  # this one does
        frames += flow("10.0.0.3", k, [(1, post), (10, b"x" * 10), (20, b"x" * 10)])  # a body drop by drop
        frames += flow("10.0.0.4", k, [(1, post), (2, b"x" * 1400), (3, b"x" * 1400)] + [(4 + i, b"x" * 1400) for i in range(20)])  # slow enough
        frames += flow("10.0.0.5", k, [(1, b"GET / HTTP/1.1\r\n\r\n"), (2, b"")], window=0)  # doesn't read
    frames += flow("10.0.0.6", 0, [(1, b"GET / HTTP/1.1\r\n"), (8, b"X: 1\r\n"), (16, b"X: 2\r\n")])  # one connection only
    got = fired(spark, tmp_path, frames, """
alert tcp any any -> any any (msg:"h"; detect:slowloris; kind:slow_headers; track:by_src; count:3; seconds:30; min_age:10; sid:1;)
alert tcp any any -> any any (msg:"s"; detect:slowloris; kind:slow_headers; track:by_dst; count:4; seconds:30; min_age:10; sid:2;)
alert tcp any any -> any any (msg:"b"; detect:slowloris; kind:slow_body; track:by_src; count:3; seconds:30; min_age:20; min_rate:100; min_remaining:10240; sid:3;)
alert tcp any any -> any any (msg:"r"; detect:slowloris; kind:slow_read; track:by_src; count:3; min_age:20; sid:4;)
""")
    assert got == {1: {"10.0.0.1"}, 2: {"192.0.2.1"}, 3: {"10.0.0.3"}, 4: {"10.0.0.5"}}


def test_nothing_applies(spark, tmp_path):
    rule = 'alert arp any any -> any any (msg:"s"; detect:arp_spoof; kind:static_violation; sid:1;)'
    assert fired(spark, tmp_path, [(1, T.ping("10.0.0.1", "10.0.0.2"))], rule) == {}


def test_scope_and_silence_of_derived_rows(spark, tmp_path):
    """Rules see handshakes, probes, DNS and echo answers only inside their header's addresses, and not those of silenced hosts."""
    frames = []
    for k, src in enumerate(("203.0.113.5", "10.0.0.5", "10.0.0.6", "10.0.0.7")):
        frames += [(k + i / 100, T.tcp(src, 2000 + i, "192.0.2.9", 80, "S", seq=i)) for i in range(6)]  # opened, never answered
        frames += [(k + 0.2 + i / 100, T.tcp(src, 3000 + i, "192.0.2.9", 100 + i, "S", seq=i)) for i in range(6)]
        frames += [(k + 0.4 + i / 100, T.tcp(src, 4000 + i, f"192.0.2.{20 + i}", 25, "S", seq=i)) for i in range(6)]
        frames += [(k + 0.6 + i / 100, T.ping("198.51.100.1", src, kind=0, ident=i)) for i in range(6)]  # answers to nothing
        frames += [(k + 0.8 + i / 100, T.udp(src, 5000, "192.0.2.53", 53, T.query(i, f"x{i}qzv8k{i}wj2.evil.example"))) for i in range(6)]
    frames.append((90, T.udp("192.0.2.1", 9, "192.0.2.2", 9)))
    rules = """
alert tcp 10.0.0.0/8 any -> any 80 (msg:"f"; detect:syn_flood; track:by_src; count:5; seconds:5; min_incomplete_ratio:0.8; max_distinct_ports:50; sid:1;)
alert ip 10.0.0.0/8 any -> any any (msg:"p"; detect:port_scan; distinct_ports:6; seconds:5; sid:2;)
alert ip 10.0.0.0/8 any -> any any (msg:"h"; detect:host_sweep; distinct_hosts:6; seconds:5; sid:3;)
alert icmp any any -> 10.0.0.0/8 any (msg:"u"; detect:icmp_flood; kind:unsolicited_reply; count:5; seconds:5; sid:4;)
alert ip 10.0.0.0/8 any -> any any (msg:"t"; detect:dns_tunnel; kind:subdomains; count:5; seconds:5; min_entropy:1; sid:5;)
pass ip 10.0.0.7 any -> any any (msg:"quiet"; sid:9;)
"""
    got = fired(spark, tmp_path, frames, rules, whitelist="10.0.0.6")
    assert {sid: {k.split("|")[0] for k in keys} for sid, keys in got.items()} == {1: {"10.0.0.5"}, 2: {"10.0.0.5"}, 3: {"10.0.0.5"}, 4: {"10.0.0.5", "10.0.0.6", "10.0.0.7"}, 5: {"10.0.0.5"}}


def test_icmp_tunnel_not_by_ordinary_pings(spark, tmp_path):
    noise = lambda i: bytes((x * 167 + i * 31 + x * x) % 251 for x in range(400 + 20 * i))
    plain = bytes(range(256)) * 2
    frames = [(i / 10, T.ping("10.0.0.1", "192.0.2.1", n=i, data=noise(i))) for i in range(10)]
    frames += [(i / 10, T.ping("10.0.0.2", "192.0.2.1", n=i, data=plain[: 300 + 20 * i])) for i in range(10)]
    got = fired(spark, tmp_path, frames, 'alert ip any any -> any any (msg:"i"; detect:icmp_tunnel; count:6; seconds:60; sid:1;)')
    assert got == {1: {"10.0.0.1|192.0.2.1"}}
