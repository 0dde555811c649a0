"""TCP payloads put in order, and the application messages in them: a fold over the packets of one connection.

Each direction hands on its bytes in sequence order. A message belongs to the packet that completes it, however many segments
it spans; HTTP bodies are skipped. A direction that is lost (a gap of 5 s, an anomaly, bytes that begin no message) takes up again at
the next segment that begins one; what it sends until then keeps the messages that single packets give.
State is 16 early segments, one unfinished message and the last HISTORY bytes of each direction of one connection.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import decode
from .handshake import ACK, RST, SYN, connection
from .primitives import scanned

#: Limits of an engine that reads streams packet by packet.
HOLD, GAP_NS, IDLE_NS = 16, 5_000_000_000, 120_000_000_000
HISTORY = RESET_WINDOW = 1 << 20
HEAD, LINE, RECORD = 16384, 8192, (1 << 14) + 2048
OVERLAP, OVERSIZE, EARLY = "overlap_conflict", "oversize_headers", "too_many_ooo_segments"
MESSAGES = "array<map<string,string>>"


class Lost(Exception):
    """The direction cannot be read on; the argument is an anomaly, if that is why."""


class _Side:
    """One direction of a connection."""

    def __init__(self, expect: int | None = None):
        self.expect = expect  # sequence number of the next byte
        self.held: dict[int, bytes] = {}  # early segments by sequence number
        self.since = 0  # when the gap before them was seen
        self.sent = b""  # the bytes right before expect
        self.begin()

    def begin(self) -> None:
        """At the start of a message."""
        self.buffer, self.lost, self.through, self.silent, self.newline = b"", False, False, False, False

    def lose(self, silent: bool = False) -> None:
        self.buffer, self.lost, self.silent, self.sent = b"", True, silent, b""

    def at(self, number: int) -> int:
        """How far a sequence number is past the expected one."""
        return (number - self.expect + (1 << 31)) % (1 << 32) - (1 << 31)

    def advance(self, data: bytes) -> None:
        self.expect = (self.expect + len(data)) % (1 << 32)
        self.sent = (self.sent + data)[-HISTORY:] if len(self.sent) < 2 * HISTORY else self.sent[-HISTORY:] + data


def _differ(a: bytes, b: bytes) -> bool:
    n = min(len(a), len(b))
    return a[:n] != b[:n]


class Conversation:
    """Reads one connection; add() gives a packet's (messages, their bytes, anomaly), with None for messages where the packet's own stand."""

    def __init__(self, ports: dict[int, str]):
        self.ports, self.last, self.sides = ports, None, {}

    def _open(self, client: tuple, server: tuple) -> None:
        self.client, self.protocol = client, self.ports.get(server[1])
        self.sides, self.asked = {client: _Side(), server: _Side()}, []

    def add(self, now: int, src: str, sport: int, dst: str, dport: int, flags: int, number: int, payload: bytes | None) -> tuple:
        me, other = (src, sport), (dst, dport)
        if self.last is not None and now - self.last > IDLE_NS:
            self.sides = {}
        self.last = now
        if flags & SYN:
            if not flags & ACK:
                self._open(me, other)
            elif me not in self.sides:
                self._open(other, me)
            self.sides[me] = _Side((number + 1) % (1 << 32))
            return None, None, None
        side = self.sides.get(me)
        if flags & RST:
            if side is not None and (side.expect is None or abs(side.at(number)) <= RESET_WINDOW):
                self.sides = {}
            return None, None, None
        data = bytes(payload or b"")
        if not data:
            return None, None, None
        if side is None:  # the capture began later: the server has a known port, the lower one if both have
            server = me if me[1] in self.ports and (other[1] not in self.ports or me[1] < other[1]) else other
            self._open(other if server == me else me, server)
            side = self.sides[me]
        if side.expect is None:
            side.expect, side.lost = number, not self._starts(side, me, data)
        found: list[tuple[list, bytes]] = []
        anomaly, own = None, side.through
        if not side.through:
            try:
                self._place(side, me, now, number, data, found)
            except Lost as e:
                anomaly = e.args[0] if e.args else None
                if side.at(number + len(data)) > 0:
                    side.expect = (number + len(data)) % (1 << 32)
                side.held = {}
                side.lose()
        if found:
            return [m for ms, _ in found for m in ms], b"".join(b for _, b in found), anomaly
        own = own or side.lost and not side.silent
        return (None if own or self.protocol is None else []), None, anomaly

    # ---- order

    def _place(self, side: _Side, me: tuple, now: int, number: int, data: bytes, found: list) -> None:
        if side.held and now - side.since >= GAP_NS:  # what is missing will not come
            early, side.held = sorted(side.held.items(), key=lambda x: side.at(x[0])), {}
            side.lose()
            for n, d in early:
                if side.at(n) > 0 and not side.lost:
                    side.lose()
                self._take(side, me, n, d, found)
        if side.at(number) > 0 and not side.lost:
            for n, d in side.held.items():
                off = (number - n + (1 << 31)) % (1 << 32) - (1 << 31)
                if _differ(d[off:], data) if off >= 0 else _differ(d, data[-off:]):
                    raise Lost(OVERLAP)
            if not side.held:
                side.since = now
            if len(side.held.get(number, b"")) < len(data):
                side.held[number] = data
            if len(side.held) > HOLD:
                raise Lost(EARLY)
            return
        self._take(side, me, number, data, found)
        while side.held and not side.lost:
            n = min(side.held, key=side.at)
            if side.at(n) > 0:
                break
            self._take(side, me, n, side.held.pop(n), found)

    def _take(self, side: _Side, me: tuple, number: int, data: bytes, found: list) -> None:
        """A segment that begins at or before the expected byte, or any segment of a lost direction."""
        if side.lost:
            if side.at(number + len(data)) <= 0:
                return
            at = self._boundary(side, me, number, data)
            side.expect = (number + (len(data) if at is None else at)) % (1 << 32)
            if at is None:
                side.newline = data.endswith(b"\n")
                return
            side.begin()
            data, number = data[at:], side.expect
        back = -side.at(number)
        if back:
            known = side.sent[-back:] if back <= len(side.sent) else b""
            if _differ(known, data):
                raise Lost(OVERLAP)
            data = data[back:]
        if data:
            side.advance(data)
            side.buffer += data
            self._read(side, me, found)

    # ---- messages

    def _starts(self, side: _Side, me: tuple, data: bytes) -> bool:
        return self._boundary(side, me, side.expect, data) == 0 or self.protocol == "ftp"

    def _boundary(self, side: _Side, me: tuple, number: int, data: bytes) -> int | None:
        """Where in a segment a message surely begins."""
        if self.protocol == "http":
            return 0 if data.startswith(decode.METHODS if me == self.client else b"HTTP/1.") else None
        if self.protocol == "dns":
            return 0 if len(data) >= 14 and decode.plausible_dns(data) else None
        if self.protocol == "tls":
            return 0 if data[:2] == b"\x16\x03" else None
        if self.protocol == "ftp":
            if side.newline and side.at(number) == 0:
                return 0
            return data.index(b"\n") + 1 if b"\n" in data else None
        return None

    def _read(self, side: _Side, me: tuple, found: list) -> None:
        reader = {"http": self._http, "dns": self._dns, "ftp": self._ftp, "tls": self._tls}.get(self.protocol)
        if reader is None:
            side.buffer, side.through = b"", True
            return
        while side.buffer and not side.lost and not side.through and reader(side, me, found):
            pass

    def _pass(self) -> None:
        for side in self.sides.values():
            side.buffer, side.sent, side.held, side.through = b"", b"", {}, True

    def _http(self, side: _Side, me: tuple, found: list) -> bool:
        data = side.buffer = side.buffer.lstrip(b"\r\n")
        starts = decode.METHODS if me == self.client else (b"HTTP/1.",)
        if not any(data.startswith(s) or s.startswith(data) for s in starts):
            raise Lost
        ends = [at + len(x) for x in (b"\n\r\n", b"\n\n") if (at := data.find(x, 0, HEAD)) >= 0]
        end = min(ends, default=None)
        if end is None or end > HEAD:
            if len(data) > HEAD:
                raise Lost(OVERSIZE)
            return False
        head, rest = data[:end], data[end:]
        lines = [x.rstrip(b"\r") for x in head.split(b"\n")]
        messages = decode.http(b"\r\n".join(lines))
        found.append((messages, head))
        side.buffer = rest
        size, chunked = _body(lines)
        if me == self.client:
            self.asked = [*self.asked[-31:], head.split(b" ", 1)[0]]
        else:
            status = int(lines[0][9:12]) if lines[0][9:12].isdigit() else 0
            if 100 <= status < 200:
                if status == 101:
                    self._pass()
                return True
            asked = self.asked.pop(0) if self.asked else b""
            if asked == b"CONNECT" and 200 <= status < 300:
                self._pass()
                return True
            if asked == b"HEAD" or status in (204, 304):
                return True
            chunked = chunked or size is None  # a body without a length lasts until a message begins
        if chunked or size is not None and not 0 <= size < 1 << 31:
            side.lose(silent=True)
        elif size:
            # the rest of a body is passed over by its sequence numbers
            side.buffer = rest[size:]
            if size > len(rest):
                side.expect, side.sent = (side.expect + size - len(rest)) % (1 << 32), b""
        return True

    def _dns(self, side: _Side, me: tuple, found: list) -> bool:
        data = side.buffer
        if len(data) < 14:
            return False
        if not decode.plausible_dns(data):
            raise Lost
        size = 2 + int.from_bytes(data[:2], "big")
        if len(data) < size:
            return False
        found.append((decode.dns(data[2:size]), data[:size]))
        side.buffer = data[size:]
        return True

    def _ftp(self, side: _Side, me: tuple, found: list) -> bool:
        line, end, rest = side.buffer.partition(b"\n")
        if len(line) > LINE:
            raise Lost
        if not end:
            return False
        messages = decode.ftp(line.rstrip(b"\r"))
        found.append((messages, line + end))
        side.buffer = rest
        if me != self.client and line[:4] == b"234 ":  # TLS from here on
            self._pass()
        return True

    def _tls(self, side: _Side, me: tuple, found: list) -> bool:
        data = side.buffer
        if data[:2] != b"\x16\x03"[: len(data)] or len(data) >= 5 and int.from_bytes(data[3:5], "big") > RECORD:
            raise Lost
        if len(data) < 5 or len(data) < (size := 5 + int.from_bytes(data[3:5], "big")):
            return False
        found.append((decode.tls(data[:size]), data[:size]))
        side.buffer, side.sent, side.through = b"", b"", True  # only the first record is plain
        return True


def _body(lines: list[bytes]) -> tuple[int | None, bool]:
    """The length a head gives its body (None: none given, -1: unclear) and whether it comes in chunks."""
    sizes, chunked = set(), False
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        name, value = name.strip().lower(), value.strip()
        if name == b"content-length":
            sizes.add(int(value) if value.isdigit() else -1)
        chunked = chunked or name == b"transfer-encoding" and b"chunked" in value.lower()
    return (None if not sizes else sizes.pop() if len(sizes) == 1 else -1), chunked


def reassembled(packets: DataFrame, ports: dict[int, str] | None = None) -> DataFrame:
    """packets with the app_msgs that a TCP packet on some port completes, their bytes as app_data, and stream_anomaly.

    Only packets of such connections move, once; all others pass by as they are."""
    ports = decode.PORTS if ports is None else ports
    listed = [int(p) for p in ports]
    on_port = F.coalesce((F.col("g") == "TCP") & (F.col("sport").isin(listed) | F.col("dport").isin(listed)), F.lit(False))
    packets = packets.drop("app_data", "stream_anomaly")

    def fold():
        talk = Conversation(ports)

        def add(now, *values):
            messages, data, anomaly = talk.add(now, *values)
            return None if messages is None else json.dumps(messages), data, anomaly

        return add

    new = [T.StructField("__msgs", T.StringType()), T.StructField("app_data", T.BinaryType()), T.StructField("stream_anomaly", T.StringType())]
    mine = scanned(packets.where(on_port).withColumn("__conn", connection()), ["__conn"], fold, ["src", "sport", "dst", "dport", "tcp_flags", "tcp_seq", "payload"], new)
    mine = mine.withColumn("app_msgs", F.coalesce(F.from_json("__msgs", MESSAGES), F.col("app_msgs"))).drop("__conn", "__msgs")
    rest = packets.where(~on_port).withColumns({"app_data": F.lit(None).cast("binary"), "stream_anomaly": F.lit(None).cast("string")})
    return rest.unionByName(mine)
