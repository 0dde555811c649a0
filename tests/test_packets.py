"""Capture files, decoders, rules and the engine, on made-up traffic."""

import hashlib
import os
import struct
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import packets as T  # noqa: E402

from packetloom.operators import handshake  # noqa: E402
from packetloom.plans import rules as R  # noqa: E402
from packetloom.plans.engine import Engine  # noqa: E402
from packetloom.sources import decode as X  # noqa: E402
from packetloom.sources import logs, pcap  # noqa: E402

S = 10**9


def test_decode_tcp_http():
    req = b"GET /a%2e%2e/b?x=1+2%27 HTTP/1.1\r\nHost: h.example:80\r\nAuthorization: Basic c2VjcmV0\r\n\r\n"
    d = X.decode(T.tcp("10.0.0.1", 4000, "192.0.2.1", 80, "PA", 7, 9, req))
    m = d["app_msgs"][0]
    assert (d["g"], d["src"], d["dport"], d["tcp_flags"], d["ip_checksum_valid"]) == ("TCP", "10.0.0.1", 80, 24, True)
    assert (m["method"], m["uri_decoded"], m["query"], m["auth_basic"]) == ("GET", "/a../b?x=1+2'", "x=1 2'", "true") and "c2VjcmV0" not in str(d["app_msgs"])
    assert X.suspicious("/%252e%252e%252f") == "double percent-encoding" and X.suspicious("/%c0%af") == "overlong utf-8 encoding" and X.suspicious("/%41") is None


def test_decode_dns():
    d = X.decode(T.udp("10.0.0.1", 5000, "192.0.2.53", 53, T.query(7, "WWW.Example.COM", 16)))
    assert d["app_msgs"] == [{"id": "7", "is_response": "false", "rcode": "0", "questions": "1", "answers": "0", "qname": "www.example.com", "qtype": "16", "qtype_name": "TXT"}]
    loop = T.query(1, "a")[:12] + b"\xc0\x0c\0\1\0\1"
    assert X.dns(loop)[0]["malformed_reason"] and X.dns(b"x")[0]["malformed_reason"]


@pytest.mark.parametrize("ident", [7, 0x1603])
@pytest.mark.parametrize("port", [5000, 80, 8000, 8080, 8443, 21])
def test_dns_of_any_id_and_client_port(ident, port):
    """An id that looks like a TLS record and a client port of another protocol leave a message on port 53 DNS."""
    for response in (False, True):
        ends = ("192.0.2.53", 53, "10.0.0.1", port) if response else ("10.0.0.1", port, "192.0.2.53", 53)
        message = T.query(ident, "a.example", response=response)
        for frame in (T.udp(*ends, message), T.tcp(*ends, "PA", 7, 9, struct.pack("!H", len(message)) + message)):
            d = X.decode(frame)
            assert d["app_protocol"] == "dns" and (d["app_msgs"][0]["id"], d["app_msgs"][0]["qname"]) == (str(ident), "a.example")
    d = X.decode(T.tcp("10.0.0.1", port, "192.0.2.53", 53, "PA", 7, 9, struct.pack("!H", 0x1603) + T.query(ident, "a.example")))
    assert d["app_protocol"] == "dns"  # a length that looks like a TLS record


def test_application_needs_looks():
    assert X.decode(T.udp("10.0.0.1", 5000, "192.0.2.1", 443, T.hello("a.example")))["app_protocol"] == "UNKNOWN"
    for port in (53, 443, 5000):  # by looks on a port of another protocol
        assert X.decode(T.tcp("10.0.0.1", 5000, "192.0.2.1", port, "PA", 7, 9, b"GET / HTTP/1.1\r\n\r\n"))["app_protocol"] == "http"
    for port in (53, 80, 5000):
        assert X.decode(T.tcp("10.0.0.1", 5000, "192.0.2.1", port, "PA", 7, 9, T.hello("a.example")))["app_msgs"][0]["sni"] == "a.example"
    assert X.decode(T.tcp("10.0.0.1", 8080, "192.0.2.1", 21, "PA", 7, 9, b"USER a\r\n"))["app_protocol"] == "ftp"
    assert X.decode(T.tcp("192.0.2.1", 21, "10.0.0.1", 8080, "PA", 7, 9, b"530 no\r\n"))["app_msgs"][0]["response_code"] == "530"
    assert X.decode(T.tcp("10.0.0.1", 5000, "192.0.2.1", 80, "PA", 7, 9, b"\0\1 no HTTP"))["app_protocol"] == "http"


def test_decode_tls():
    m = X.tls(T.hello("A.Example"))[0]
    assert m["sni"] == "a.example" and m["ja3"] == "771,4865-49199,0-10-11,29-23,0" and m["ja3_hash"] == hashlib.md5(m["ja3"].encode()).hexdigest()
    assert "ja3" not in X.tls(T.hello("a.example")[:60] )[0]


def test_decode_other():
    assert X.decode(b"short")["parse_errors"] and X.decode(T.ip4(6, "1.1.1.1", "2.2.2.2", b"xx"))["g"] == "IP"
    d = X.decode(T.arp(2, "10.0.0.1", 5, "10.0.0.2"))
    assert (d["g"], d["arp_op"], d["src"], d["arp_sender_mac"]) == ("ARP", 2, "10.0.0.1", "02:00:00:00:00:05")
    tagged = T.ping("1.1.1.1", "2.2.2.2")
    assert X.decode(tagged[:12] + b"\x81\0\0\1" + tagged[12:])["icmp_type"] == 8
    assert X.ftp(b"USER bob\r\nPASS hunter2\r\n530 no\r\n") == [{"is_response": "false", "command": "USER", "argument": "bob"}, {"is_response": "false", "command": "PASS", "argument": "[redacted]"}, {"is_response": "true", "response_code": "530"}]


def traffic():
    out, now = [], 0

    def add(frame, gap=S // 10):
        nonlocal now
        out.append((now, frame))
        now += gap

    for p in range(1, 26):  # a scan: refused connections
        add(T.tcp("203.0.113.5", 40000 + p, "192.0.2.1", p, "S", 100))
        add(T.tcp("192.0.2.1", p, "203.0.113.5", 40000 + p, "RA", 0, 101), S // 50)
    add(T.tcp("10.0.0.9", 5000, "192.0.2.1", 80, "S", 10))  # a good handshake
    add(T.tcp("192.0.2.1", 80, "10.0.0.9", 5000, "SA", 70, 11))
    add(T.tcp("10.0.0.9", 5000, "192.0.2.1", 80, "A", 11, 71))
    add(T.tcp("10.0.0.9", 5000, "192.0.2.1", 80, "PA", 11, 71, b"GET /?q=1%27+or+1%3D1 HTTP/1.1\r\nHost: bad.example.org\r\n\r\n"))
    for i in range(20):
        add(T.ping("203.0.113.6", f"192.0.2.{i + 1}"))
    add(T.tcp("192.0.2.7", 9, "192.0.2.7", 9, "S"))
    for i in range(6):
        add(T.arp(2, "10.1.1.1", 5 + i % 2, "10.1.1.10"), 2 * S)
    add(T.udp("10.0.0.9", 999, "192.0.2.53", 53, T.query(1, "www.Listed.example")))
    return out


RULES = r"""
var HOME [10.0.0.0/8]
feed domain bad feeds/bad.txt max_age:0
stage recon recon
pass icmp 203.0.113.99 any -> any any (sid:9;)
alert ip any any -> any any (msg:"Port scan"; detect:port_scan; distinct_ports:20; seconds:10; sid:1; category:recon;)
alert tcp any any -> any any (msg:"land"; same_ip; same_port; flags:S+; sid:2; severity:high;)
alert tcp $HOME any -> !$HOME any (msg:"sqli; \"x\""; app_proto:http; regex:query,"(?i)['\"]\s*or\s+\d+\s*=\s*\d+$"; sid:3;)
alert icmp any any -> any any (msg:"sweep"; detect:ping_sweep; distinct_hosts:15; seconds:30; sid:4;)
alert arp any any -> any any (msg:"flip"; detect:arp_spoof; kind:flip_flop; count:3; seconds:60; sid:5;)
alert ip any any -> any any (msg:"listed"; domain_feed:bad; sid:6;)
alert tcp any any -> any any (msg:"many"; flags:RA; detection_filter:track by_src, count 5, seconds 30; sid:7;)
alert tcp any any -> any any (msg:"content"; content:"|47 45|t /"; nocase; sid:8;)
"""


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    (path / "one.pcap").write_bytes(T.pcap(traffic()))
    return path


def test_engine(spark, capture):
    rows = pcap.packets(pcap.read_frames(spark, f"{capture}/*.pcap")).cache()
    assert rows.count() == len(traffic()) and rows.select(F.max("seq")).first()[0] == len(traffic()) - 1
    listed = spark.createDataFrame([("listed.example",)], "entry string")
    alerts = Engine(R.parse(RULES), rows, feed_tables={"bad": listed}).alerts().collect()
    first = {r.sid: r for r in alerts if r.kind == "alert"}
    assert set(first) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert first[1].src == "203.0.113.5" and first[2].src == first[2].dst == "192.0.2.7" and first[3].msg == 'sqli; "x"' and first[6].src == "10.0.0.9"
    assert {r.sid: r["count"] for r in alerts if r.kind == "summary"}[7] == 21
    again = Engine(R.parse(RULES), rows.repartition(5), feed_tables={"bad": listed}).alerts()
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, alerts), key=str)
    silent = Engine(R.parse(RULES), rows, whitelist="[203.0.113.0/24]", feed_tables={"bad": listed}).alerts()
    assert 4 not in {r.sid for r in silent.collect()}


def test_handshakes(spark, capture):
    rows = pcap.packets(pcap.read_frames(spark, f"{capture}/*.pcap"))
    got = {r.outcome: r["count"] for r in handshake.outcomes(rows).groupBy("outcome").count().collect()}
    assert got == {"reset": 25, "complete": 1, "timeout": 1}


def test_pcap_source(spark, capture, tmp_path):
    pcap.register(spark)
    rows = spark.read.format("pcap").option("path", str(capture)).load()
    assert rows.count() == len(traffic())
    rows.select("file", "n", "ts_ns", "wire_len", "frame").coalesce(1).write.format("pcap").mode("append").option("path", str(tmp_path / "out")).save()
    back = spark.read.format("pcap").option("path", str(tmp_path / "out")).load()
    assert sorted(bytes(r.frame) for r in back.collect()) == sorted(bytes(f) for _, f in traffic())


@pytest.mark.parametrize("content,frames", [(T.pcap(traffic())[:-5], len(traffic()) - 1), (T.pcap([]), 0), (T.pcap([])[:10], 0)])
def test_damaged(content, frames):
    from io import BytesIO

    assert len(list(pcap.frames(BytesIO(content).read))) == frames


def test_not_a_capture():
    from io import BytesIO

    for content in (b"nonsense", T.pcap([])[:20] + b"\x71\0\0\0"):
        with pytest.raises(pcap.CaptureError):
            list(pcap.frames(BytesIO(content).read))


@pytest.mark.parametrize("text,problem", [
    ("alert tcp any any -> any any (msg:\"x\";)", "no sid"), ("alert tcp any -> any any (sid:1;)", "action proto"), ("alert foo any any -> any any (sid:1;)", "unknown protocol"), ("alert tcp $A any -> any any (sid:1;)", "unknown variable"),
    ("alert tcp any any -> any any (sid:1; nope:2;)", "does not belong"), ("alert tcp any any -> any any (sid:1; regex:query,\"(?=x)\";)", "look-around"), ("alert tcp any any -> any any (sid:1; severity:odd;)", "severity"),
    ("alert tcp any any -> any any (sid:1;)\nalert tcp any any -> any any (sid:1;)", "again"), ("var A $B\nvar B $A\nalert tcp $A any -> any any (sid:1;)", "refers to itself"), ("drop it", "unknown word"), ("alert ip any any -> any any (sid:1; ip_feed:x;)", "unknown feed"),
    ("alert ip any any -> any any (sid:1; detect:port_scan; distinct_ports:0; seconds:10;)", "out of range"), ("alert ip any any -> any any (sid:1; detect:port_scan; seconds:10; flags:S;)", "no signature options"),
])
def test_rule_errors(text, problem):
    with pytest.raises(R.RuleErrors) as e:
        R.parse(text)
    assert problem in str(e.value)


def test_all_errors_at_once():
    with pytest.raises(R.RuleErrors) as e:
        R.parse("nonsense\nalert tcp any any -> any any (msg:\"x\";)\nvar A\n")
    assert [n for n, _ in e.value.problems] == [1, 2, 3]


def test_logs(spark, tmp_path):
    df = spark.createDataFrame([("2024", 1, "high"), ("2025", 2, "low")], "time string, sid int, severity string")
    logs.write_log(df, str(tmp_path / "log"))
    (tmp_path / "log" / "zz.json").write_text('{"type":"alert","sid":3}\n{"type":"al')
    got = logs.read_log(spark, str(tmp_path / "log"))
    assert sorted(r.sid for r in got.where("_corrupt is null").collect()) == [1, 2, 3] and got.cache().where("_corrupt is not null").count() == 1
