"""Queries from frames on: Ethernet frames built from `events`, then decoders, TCP and DNS state and the rule engine over them.

What went into a frame is known, so the SQL over `events` says what must come out. clicks are HTTP requests, views DNS questions,
errors ICMP, signups ARP, all else SYNs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import handshake as H
from ..sources import pcap
from . import rules as R
from .catalog import packets, query
from .engine import Engine

FILES = 16  # captures that the frames are dealt to
FIRST = 10 << 24  # the address of user 0
NUMBER = (1 << 40) - 1  # the frame's number within seq


def _n(value: Column | int, width: int) -> Column:
    """A number as hex digits."""
    return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), width, "0")


def _bytes(hex_: Column) -> Column:
    return F.floor(F.length(hex_) / 2)


def _text(*parts: str | Column) -> Column:
    return F.hex(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _src() -> Column:
    """An address for each of 2^32 users, 10.0.0.0 the first: more than 65,536 of them go on at 10.1.0.0."""
    return _n((F.col("user_id") + FIRST) % (1 << 32), 8)


def _user(address: Column) -> Column:
    """An address of _src() as `packets` writes it, where what follows 10.0 is the user's number by 256: 10.1.2.3 is 10.0.258.3."""
    octets = F.split(address, r"\.")
    n = sum((octets[i].cast("long") * (1 << 24 - 8 * i) for i in range(4)), F.lit(-FIRST))
    return F.concat(F.lit("10.0."), F.shiftright(F.pmod(n, F.lit(1 << 32)), 8).cast("string"), F.lit("."), octets[3])


def _dst() -> Column:
    return F.concat(F.lit("C00002"), _n(F.col("k"), 2))


def _port() -> Column:
    return 1024 + F.col("seq") % 60000


def _macs() -> Column:
    return F.concat(F.lit("02000000000202000000"), _n(F.col("user_id") % 65536, 4))


def _ip(proto: int, src: Column, dst: Column, body: Column) -> Column:
    return F.concat(F.lit("4500"), _n(20 + _bytes(body), 4), _n(F.col("seq") % 65536, 4), F.lit("0000"), _n(40 + F.col("k") % 20, 2), _n(proto, 2), F.lit("0000"), src, dst, body)


def _tcp(sport: Column, dport: Column, seq: Column, ack: Column, flags: Column | int, payload: Column) -> Column:
    return F.concat(_n(sport, 4), _n(dport, 4), _n(seq, 8), _n(ack, 8), F.lit("50"), _n(flags, 2), F.lit("FFFF00000000"), payload)


def _udp(sport: Column, dport: Column, payload: Column) -> Column:
    return F.concat(_n(sport, 4), _n(dport, 4), _n(8 + _bytes(payload), 4), F.lit("0000"), payload)


def _dns(flags: str, label: Column) -> Column:
    name = F.concat(_n(F.length(label), 2), F.hex(label), F.lit("07"), _text("example"), F.lit("03"), _text("org"), F.lit("00"))
    return F.concat(_n(F.col("seq") % 65536, 4), F.lit(flags + "0001000000000000"), name, F.lit("00010001"))


def _decoded(events: DataFrame, frame: Column, number: Column) -> DataFrame:
    """Decoded packets of one frame a row; number orders them."""
    rows = events.withColumn("frame", F.unhex(frame)).where("frame is not null")
    rows = rows.select(F.format_string("capture-%02d", F.col("user_id") % FILES).alias("file"), number.cast("long").alias("n"), (F.col("t") * 1000).alias("ts_ns"), F.octet_length("frame").cast("long").alias("wire_len"), "frame")
    return pcap.packets(rows)


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("k"), F.lit("")
    request = _text("GET /", k, "?q=", F.col("seq"), " HTTP/1.1\r\nHost: h", F.col("user_id"), ".example.com\r\n\r\n")
    http = _ip(6, _src(), _dst(), _tcp(_port(), F.lit(80), F.col("seq"), F.lit(1), 24, request))
    syn = _ip(6, _src(), _dst(), _tcp(_port(), F.col("dport"), F.col("seq"), F.lit(0), 2, none))
    dns = _ip(17, _src(), _dst(), _udp(_port(), F.lit(53), _dns("0100", F.concat(F.lit("n"), k.cast("string")))))
    echo = F.concat(F.lit("08000000"), _n(k, 4), _n(F.col("seq") % 65536, 4), _text("abcdefgh"))
    quoted = _ip(17, _dst(), _src(), _udp(F.lit(53), _port(), none))
    icmp = _ip(1, _src(), _dst(), F.when(k % 2 == 0, echo).otherwise(F.concat(F.lit("0303000000000000"), quoted)))
    arp = F.concat(F.lit("000108000604"), _n(1 + k % 2, 4), F.lit("02000000"), _n(F.col("user_id") % 65536, 4), _src(), F.lit("000000000000"), _dst())
    body = F.when(F.col("event_type") == "click", http).when(F.col("event_type") == "view", dns).when(F.col("event_type") == "error", icmp).when(F.col("event_type") == "signup", arp).otherwise(syn)
    kind = F.when(F.col("event_type") == "signup", "0806").otherwise("0800")
    return _decoded(packets(spark, sf), F.concat(_macs(), kind, body), F.col("seq"))


_NET = "CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'error' THEN 'ICMP' WHEN 'signup' THEN 'ARP' ELSE 'TCP' END"
_X = f""", x AS (SELECT *, {_NET} AS g, event_type = 'error' AND k % 2 = 0 AS echo, event_type = 'error' AND k % 2 = 1 AS refused, event_type NOT IN ('click', 'view', 'error', 'signup') AS syn FROM packets) """


_NUMBERS = ["ttl", "ip_proto", "sport", "dport", "tcp_flags", "tcp_seq", "icmp_type", "echo_id", "quoted_dport", "arp_op"]  # -1 where a frame has none


@query(_X + """, d AS (SELECT seq, g, src, dst, printf('02:00:00:00:%02x:%02x', (user_id % 65536) // 256, user_id % 256) AS eth_src,
  CASE WHEN g <> 'ARP' THEN 40 + k % 20 END AS ttl, CASE g WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 END::BIGINT AS ip_proto,
  CASE WHEN g IN ('TCP', 'UDP') THEN 1024 + seq % 60000 END AS sport, CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 53 ELSE CASE WHEN syn THEN dport END END::BIGINT AS dport,
  CASE WHEN syn THEN 2 WHEN event_type = 'click' THEN 24 END::BIGINT AS tcp_flags, CASE WHEN g = 'TCP' THEN seq END AS tcp_seq, CASE WHEN echo THEN 8 WHEN refused THEN 3 END::BIGINT AS icmp_type, CASE WHEN echo THEN k END AS echo_id,
  CASE WHEN refused THEN dst END AS quoted_src, CASE WHEN refused THEN 1024 + seq % 60000 END AS quoted_dport, CASE WHEN g = 'ARP' THEN 1 + k % 2 END AS arp_op FROM x) SELECT seq, g, src, dst, eth_src, quoted_src, """ + ", ".join(f"CAST(coalesce({c}, -1) AS BIGINT) AS {c}" for c in _NUMBERS) + " FROM d")
def decode_frames(spark, sf):
    got = _mixed(spark, sf)
    numbers = [F.coalesce(F.col("ip_ttl" if c == "ttl" else c).cast("long"), F.lit(-1).cast("long")).alias(c) for c in _NUMBERS]
    return got.select(F.col("seq").bitwiseAND(F.lit(NUMBER)).alias("seq"), "g", _user(F.col("src")).alias("src"), "dst", "eth_src", "quoted_src", *numbers)


@query(_X + """SELECT seq, CASE WHEN event_type = 'click' THEN 'http' ELSE 'dns' END AS protocol, CASE WHEN event_type = 'click' THEN '/' || k || '?q=' || seq END AS uri,
  CASE WHEN event_type = 'click' THEN 'h' || user_id || '.example.com' END AS host, CASE WHEN event_type = 'click' THEN 'q=' || seq END AS query,
  CASE WHEN event_type = 'view' THEN 'n' || k || '.example.org' END AS qname, CASE WHEN event_type = 'view' THEN 'A' END AS qtype, CASE WHEN event_type = 'view' THEN CAST(seq % 65536 AS VARCHAR) END AS id FROM x WHERE event_type IN ('click', 'view')""")
def decode_messages(spark, sf):
    got = _mixed(spark, sf).where("app_protocol is not null")
    m = F.col("app_msgs")[0]
    return got.select(F.col("seq").bitwiseAND(F.lit(NUMBER)).alias("seq"), F.col("app_protocol").alias("protocol"), m["uri"].alias("uri"), m["host"].alias("host"), m["query"].alias("query"), m["qname"].alias("qname"), m["qtype_name"].alias("qtype"), m["id"].alias("id"))


RULES = r"""
pass tcp 10.0.0.5 any -> any any (msg:"trusted"; sid:100;)
alert tcp any any -> any any (msg:"syn"; flags:S; sid:1;)
alert udp any any -> any 53 (msg:"name"; app_proto:dns; app_domain:qname,n7.example.org; sid:2;)
alert icmp 10.0.0.0/24 any -> any any (msg:"ping"; itype:8; icode:0; sid:3;)
alert arp any any -> any any (msg:"reply"; arp_op:reply; sid:4;)
alert tcp any any -> any 80 (msg:"path"; content:"get /4"; nocase; sid:5;)
alert ip any any -> any any (msg:"ttl"; ttl:<45; sid:6;)
alert tcp 192.0.2.0/28 80 <> any any (msg:"both ways"; app_field:method=GET; dsize:>10; sid:7;)
alert tcp any any -> any any (msg:"pattern"; regex:uri,"^/[0-9]?5\?q="; sid:8;)
"""


@query(_X + """, h AS (SELECT unnest([CASE WHEN syn THEN 1 END, CASE WHEN event_type = 'view' AND k = 7 THEN 2 END, CASE WHEN echo AND user_id < 256 THEN 3 END, CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN 4 END,
  CASE WHEN event_type = 'click' AND starts_with(CAST(k AS VARCHAR), '4') THEN 5 END, CASE WHEN g <> 'ARP' AND k % 20 < 5 THEN 6 END, CASE WHEN event_type = 'click' AND k < 16 THEN 7 END,
  CASE WHEN event_type = 'click' AND k % 10 = 5 AND k < 100 THEN 8 END]) AS sid FROM x WHERE NOT (g = 'TCP' AND user_id = 5)) SELECT CAST(sid AS INT) AS sid, count(*) AS n FROM h WHERE sid IS NOT NULL GROUP BY 1""")
def engine_signatures(spark, sf):
    return Engine(R.parse(RULES), _mixed(spark, sf)).firings().groupBy("sid").agg(F.count("*").alias("n"))


@query("SELECT CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'reset' ELSE 'timeout' END AS outcome, count(*) AS n FROM packets WHERE event_type = 'purchase' GROUP BY 1")
def handshake_outcomes(spark, sf):
    k, none, seq = F.col("k"), F.lit(""), F.col("seq")
    step = packets(spark, sf).where("event_type = 'purchase'").withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(3)])))
    back = _ip(6, _dst(), _src(), _tcp(F.col("dport"), _port(), F.lit(7), seq + 1, F.when(k % 3 == 0, 18).otherwise(20), none))
    there = _ip(6, _src(), _dst(), _tcp(_port(), F.col("dport"), F.when(F.col("j") == 0, seq).otherwise(seq + 1), F.when(F.col("j") == 0, 0).otherwise(8), F.when(F.col("j") == 0, 2).otherwise(16), none))
    step = step.where("j = 0 or j = 1 and k % 3 < 2 or j = 2 and k % 3 = 0")
    got = _decoded(step, F.concat(_macs(), F.lit("0800"), F.when(F.col("j") == 1, back).otherwise(there)), seq * 4 + F.col("j"))
    return H.outcomes(got).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT CASE k % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'mismatch' ELSE 'unsolicited' END AS outcome, count(*) AS n FROM packets WHERE event_type = 'view' GROUP BY 1")
def dns_transactions(spark, sf):
    k = F.col("k")
    step = packets(spark, sf).where("event_type = 'view'").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).where("j = 1 or k % 3 < 2")
    label = F.concat(F.when((F.col("j") == 1) & (k % 3 == 1), "other").otherwise("n"), k.cast("string"))
    ask, answer = _ip(17, _src(), _dst(), _udp(_port(), F.lit(53), _dns("0100", label))), _ip(17, _dst(), _src(), _udp(F.lit(53), _port(), _dns("8180", label)))
    got = _decoded(step, F.concat(_macs(), F.lit("0800"), F.when(F.col("j") == 0, ask).otherwise(answer)), F.col("seq") * 2 + F.col("j"))
    return Engine(R.parse(RULES), got).dns_events.where("what = 'response'").groupBy("outcome").agg(F.count("*").alias("n"))
