"""Application messages across TCP segments: every way of cutting and ordering must give the same, and rules must see them."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import packets as T  # noqa: E402

from packetloom.operators.streams import EARLY, OVERLAP, OVERSIZE, Conversation  # noqa: E402
from packetloom.plans import rules as R  # noqa: E402
from packetloom.plans.engine import Engine  # noqa: E402
from packetloom.sources import decode, pcap  # noqa: E402

S = 10**9
C = ("10.0.0.1", 4000)


class Talk:
    """Feeds a conversation; keeps what it gave."""

    def __init__(self, port=80, isn=100):
        self.server, self.fold, self.now = ("192.0.2.1", port), Conversation(decode.PORTS), 0
        self.at = {C: isn, self.server: 900}

    def put(self, data, side=None, at=None, wait=0.01, flags=16):
        me = side or C
        self.now += int(wait * S)
        other = self.server if me == C else C
        number = self.at[me] if at is None else at
        if at is None:
            self.at[me] = (number + len(data) + (flags & 3 > 0)) % (1 << 32)
        return self.fold.add(self.now, *me, *other, flags, number % (1 << 32), data)

    def syn(self):
        self.put(b"", flags=2)
        self.put(b"", self.server, flags=18)
        return self


def uris(*results):
    return [m.get("uri", m.get("status")) for r in results for m in r[0] or []]


GET = b"GET /%d HTTP/1.1\r\nHost: a.example\r\n\r\n"
STREAM = GET % 1 + b"POST /2 HTTP/1.1\r\nContent-Length: 40\r\n\r\n" + b"GET /in-a-body HTTP/1.1\r\n\r\n".ljust(40) + b"\r\n" + GET % 3


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_and_order(seed):
    """Segments of random sizes, a few places out of order, some sent again, numbers wrapping."""
    dice = random.Random(seed)
    isn = dice.choice([100, (1 << 32) - dice.randrange(1, len(STREAM))])
    talk, parts, at = Talk(isn=isn).syn(), [], 0
    while at < len(STREAM):
        n = dice.randrange(1, 40)
        parts.append((at, STREAM[at : at + n]))
        at += n
    order = sorted(range(len(parts)), key=lambda i: i + dice.random() * 4)
    order += dice.sample(order, 3)
    got = [talk.put(parts[i][1], at=isn + 1 + parts[i][0]) for i in order]
    assert uris(*got) == ["/1", "/2", "/3"] and {r[2] for r in got} == {None}
    assert b"".join(r[1] or b"" for r in got).count(b"Host: a.example") == 2


def test_replies_and_bodies():
    talk = Talk().syn()
    s = talk.server
    got = [talk.put(b"HEAD /a HTTP/1.1\r\n\r\nGET /b HTTP/1.1\r\n\r\n"), talk.put(b"HTTP/1.1 200 OK\r\nContent-Length: 900\r\n\r\nHTTP/1.1 100 Continue\r\n\r\n", s)]
    got += [talk.put(b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nHTTP/HTTP/1.1 304 No\r\n\r\n", s)]
    assert uris(*got) == ["/a", "/b", "200", "100", "200", "304"]
    got = [talk.put(b"GET /c HTTP/1.1\r\n\r\n"), talk.put(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n", s), talk.put(b"HTTP ", s), talk.put(b"HTTP/1.1 404 No\r\nContent-Length: 0\r\n\r\n", s)]
    assert uris(*got) == ["/c", "200", "404"]
    got = [talk.put(b"GET /up HTTP/1.1\r\n\r\n"), talk.put(b"HTTP/1.1 101 Go\r\n\r\n", s), talk.put(b"GET /no HTTP/1.1\r\n\r\n")]
    assert uris(*got) == ["/up", "101"] and got[2][0] is None  # from here on each packet for itself


def test_gap_resync_and_idle():
    talk = Talk().syn()
    talk.at[C] += 50  # never seen
    assert talk.put(GET % 1)[0] == [] and talk.put(b"", wait=1)[0] is None
    assert uris(talk.put(GET % 2, wait=6)) == ["/1", "/2"]
    talk = Talk()  # no SYN: from the first request on
    assert talk.put(b"the end of something")[0] is None and uris(talk.put(GET % 1)) == ["/1"]
    assert talk.put(b"GET /half")[0] == [] and uris(talk.put(GET % 2, wait=121)) == ["/2"]
    talk.put(b"", flags=4)
    assert uris(talk.put(GET % 3, at=7)) == ["/3"]


def test_anomalies():
    talk = Talk().syn()
    talk.put(b"GET /abc")
    assert talk.put(b"GET /abd", at=101)[2] == OVERLAP
    assert uris(talk.put(GET % 1)) == ["/1"]
    talk = Talk().syn()
    talk.put(b"early", at=200)
    assert talk.put(b"eaRly", at=200)[2] == OVERLAP
    talk = Talk().syn()
    assert [talk.put(b"x", at=200 + 2 * i)[2] for i in range(17)] == [None] * 16 + [EARLY]
    talk = Talk().syn()
    got = [talk.put((b"GET / HTTP/1.1\r\n" if not i else b"") + b"a: %d\r\n" % i * 200) for i in range(20)]
    assert [r[2] for r in got if r[2]] == [OVERSIZE]
    talk = Talk().syn()
    assert talk.put(b"\0\1\2 no HTTP")[:1] == (None,) and uris(talk.put(GET % 1)) == ["/1"]


def test_other_protocols():
    one, two = T.query(1, "a.example"), T.query(2, "b.example")
    data = b"".join(len(x).to_bytes(2, "big") + x for x in (one, two))
    talk = Talk(53).syn()
    assert [m["qname"] for b in data for m in talk.put(bytes([b]))[0]] == ["a.example", "b.example"]
    talk = Talk(21).syn()
    assert [m["command"] for d in (b"USER a\r\nPA", b"SS x\r\n") for m in talk.put(d)[0]] == ["USER", "PASS"]
    assert talk.put(b"234 go\r\n", talk.server)[0][0]["response_code"] == "234" and talk.put(b"\x16\x03..")[0] is None
    talk = Talk(443).syn()
    hello = T.hello("split.example")
    assert talk.put(hello[:30])[0] == [] and talk.put(hello[30:])[0][0]["sni"] == "split.example" and talk.put(b"\x17\x03")[0] is None


RULES = """
alert tcp any any -> any 80 (msg:"a"; app_field:uri="/evil?x=1"; sid:1;)
alert tcp any any -> any 80 (msg:"c"; content:"evil"; content:"Host: a"; sid:2;)
alert tcp any any -> any any (msg:"o"; stream_anomaly:overlap_conflict; sid:3;)
alert tcp any any -> any any (msg:"h"; app_domain:sni,split.example; sid:4;)
alert tcp any any -> any 80 (msg:"r"; regex:data,"(?s)ev.l.*Host"; sid:5;)
alert arp any any -> any any (msg:"n"; detect:arp_spoof; kind:unsolicited_reply; count:2; seconds:10; sid:6;)
"""


def test_rules_see_split_messages(spark, tmp_path):
    def sent(src, port, parts, start):
        at, out = 1000, [(start, T.tcp(src, 4000, "192.0.2.1", port, "S", 999))]
        for i, data in enumerate(parts):
            out.append((start + 0.1 * (i + 1), T.tcp(src, 4000, "192.0.2.1", port, "PA", at, 1, data)))
            at += len(data)
        return out

    request = b"GET /evil?x=1 HTTP/1.1\r\nHost: a.example\r\n\r\n"
    frames = sent("10.0.0.1", 80, [request[i : i + 7] for i in range(0, len(request), 7)], 1) + sent("10.0.0.2", 80, [request], 2)
    frames += sent("10.0.0.3", 80, [b"GET /ok HTTP/1.1\r\n\r\n"], 3) + [(4, T.tcp("10.0.0.3", 4000, "192.0.2.1", 80, "PA", 1000, 1, b"GET /no HTTP/1.1\r\n\r\n"))]
    hello = T.hello("www.split.example")
    frames += sent("10.0.0.4", 443, [hello[:40], hello[40:]], 5)
    frames += [(6 + i / 10, T.arp(2, "10.0.0.7", 7, "10.0.0.7")) for i in range(3)] + [(6 + i / 10, T.arp(1, "10.0.0.8", 8, "10.0.0.8")) for i in range(4)]
    frames += [(8, T.arp(1, "10.0.0.9", 9, "10.0.0.6")), (8.1, T.arp(2, "10.0.0.6", 6, "10.0.0.9")), (8.2, T.arp(2, "10.0.0.5", 5, "10.0.0.9")), (8.3, T.arp(2, "10.0.0.5", 5, "10.0.0.9"))]
    (tmp_path / "s.pcap").write_bytes(T.pcap([(int(t * S), f) for t, f in sorted(frames, key=lambda x: x[0])]))
    rows = pcap.packets(pcap.read_frames(spark, f"{tmp_path}/s.pcap")).cache()
    got: dict[int, set] = {}
    for r in Engine(R.parse(RULES), rows).firings().collect():
        got.setdefault(r.sid, set()).add(r.src)
    both = {"10.0.0.1", "10.0.0.2"}
    assert got == {1: both, 2: both, 3: {"10.0.0.3"}, 4: {"10.0.0.4"}, 5: both, 6: {"10.0.0.8", "10.0.0.5"}}
