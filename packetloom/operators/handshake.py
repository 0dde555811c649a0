"""Outcomes of TCP handshakes: a fold over the packets of one connection, never more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .primitives import folded

FIN, SYN, RST, ACK = 1, 2, 4, 16
TIMEOUT_NS = 3_000_000_000
OUTCOMES = "seq long, t long, src string, sport int, dst string, dport int, outcome string"


def connection():
    """A key that both directions of a connection share."""
    a, b = F.concat_ws("|", "src", F.col("sport").cast("string")), F.concat_ws("|", "dst", F.col("dport").cast("string"))
    return F.concat_ws("~", F.least(a, b), F.greatest(a, b))


def outcomes(packets: DataFrame) -> DataFrame:
    """How each handshake ended, from its client's side: complete, or incomplete as reset, reused or timeout (3 s after the SYN)."""
    tcp = packets.where("g = 'TCP'").select("seq", "t", "src", "sport", "dst", "dport", "tcp_flags", "tcp_seq", "tcp_ack")
    return folded(tcp.withColumn("conn", connection()), ["conn"], _Handshakes, OUTCOMES)


class _Handshakes:
    """The open handshakes of one connection, one for each side that may be the client."""

    def __init__(self):
        self.open: dict[tuple, list] = {}  # client side -> [seq, t, isn, server isn]

    def _end(self, key: tuple, t: int, seq: int, how: str) -> tuple:
        self.open.pop(key)
        return (seq, t, *key, how)

    def add(self, p) -> list[tuple]:
        out = [self._end(key, h[1] + TIMEOUT_NS, h[0], "timeout") for key, h in list(self.open.items()) if p.t >= h[1] + TIMEOUT_NS]
        key, back = (p.src, p.sport, p.dst, p.dport), (p.dst, p.dport, p.src, p.sport)
        flags, open_ = p.tcp_flags, self.open
        if flags & RST:
            for k in (back, key):
                if k in open_:
                    out.append(self._end(k, p.t, p.seq, "reset"))
                    break
        elif flags & SYN and not flags & ACK:
            h = open_.get(key)
            if h and h[2] != p.tcp_seq:
                out.append(self._end(key, p.t, p.seq, "reused"))
                h = None
            if not h:
                open_[key] = [p.seq, p.t, p.tcp_seq, None]
        elif flags & SYN:
            h = open_.get(back)
            if h and p.tcp_ack == (h[2] + 1) % (1 << 32):
                h[3] = p.tcp_seq
        elif flags & ACK and (h := open_.get(key)) and h[3] is not None and p.tcp_ack == (h[3] + 1) % (1 << 32):
            out.append(self._end(key, p.t, p.seq, "complete"))
        return out

    def end(self) -> list[tuple]:
        return [self._end(key, h[1] + TIMEOUT_NS, h[0], "timeout") for key, h in list(self.open.items())]
