"""Scalar functions of the rule language and the detectors, as Columns (no Python at run time)."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits; 0 for the empty string. Characters are counted in sorted order, so sums repeat exactly."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


#: Payloads that ordinary ping programs send count up from 0 (after a time of 8 or 16 bytes), repeat a to w, or are zero.
PINGS = [("".join(map(chr, range(256))), 0), ("".join(map(chr, range(256))), 8), ("".join(map(chr, range(256))), 16), ("abcdefghijklmnopqrstuvw", 0), ("\0", 0)]


def standard_echo(payload: Column) -> Column:
    """Whether an echo's payload (binary) is one that ordinary ping programs send; an empty one is, a missing one isn't."""
    text = F.decode(payload, "ISO-8859-1")
    n = F.length(text)
    out = n == 0
    for unit, after in PINGS:
        whole = F.repeat(F.lit(unit), (n / len(unit)).cast("int") + 1)
        out = out | (n > after) & (F.substring(text, F.lit(after + 1), n) == F.substring(whole, F.lit(after + 1), n - after))
    return F.coalesce(out, F.lit(False))


def percent_decode(text: Column) -> Column:
    """%XX decoded once, to ISO-8859-1 (one character a byte); broken escapes and + stay."""
    parts = F.split(text, "%")
    head = F.element_at(parts, 1)

    def piece(p: Column) -> Column:
        ok = F.regexp_like(p, F.lit("^[0-9A-Fa-f]{2}"))
        byte = F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1")
        return F.when(ok, F.concat(byte, F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p))

    return F.concat(head, F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), piece), ""))


def query_string(uri: Column) -> Column:
    """From the first ? to #, + as space, then percent-decoded; empty without ?."""
    raw = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    return percent_decode(F.translate(raw, "+", " "))


def strip_port(host: Column) -> Column:
    """host of host:port; brackets of IPv6 stay whole."""
    return F.regexp_replace(host, r":[0-9]*$", "")


def left_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def parent_domains(name: Column) -> Column:
    """A name and all its parents, longest first: a.b.c, b.c, c."""
    labels = F.split(F.regexp_replace(F.lower(name), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Public suffixes of more than one label that are common in traffic; any other name's suffix is its last label.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.nz", "co.za", "com.tr", "github.io", "cloudfront.net", "blogspot.com", "amazonaws.com", "azurewebsites.net", "herokuapp.com", "in-addr.arpa", "ip6.arpa"]


def registered_domain(name: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The public suffix and one label more."""
    names = parent_domains(name)
    hits = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: F.element_at(names, i).isin(suffixes))
    at = F.coalesce(F.array_min(hits), F.size(names))
    return F.element_at(names, F.greatest(at - 1, F.lit(1)))


def initial_ttl(ttl: Column) -> Column:
    return F.when(ttl <= 32, 32).when(ttl <= 64, 64).when(ttl <= 128, 128).otherwise(255)


def hop_distance(ttl: Column) -> Column:
    return initial_ttl(ttl) - ttl


def serial_before(a: Column, b: Column) -> Column:
    """Whether a comes before b in 32-bit serial-number order."""
    ahead = F.pmod(b - a, F.lit(1 << 32))
    return (ahead > 0) & (ahead < (1 << 31))


def linear_count(zeros: Column, size: int) -> Column:
    """The linear-counting estimate from the zero bits of a bitmap of `size` bits (at least one zero is assumed)."""
    return -size * F.log(F.greatest(zeros, F.lit(1)) / F.lit(float(size)))


SEVERITIES = ["low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def ip4_number(ip: Column) -> Column:
    """An IPv4 address as a BIGINT; null if it isn't one."""
    ok = F.regexp_like(ip, F.lit(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))
    return F.when(ok, number)


def clean_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cc}", "?")


def fnv1a_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def incident_id(kind: str, sid: int, a: str, b: str) -> str:
    return f"inc-{fnv1a_64(f'{kind}|{sid}|{a}|{b}'.encode()):016x}"


def parse_size(text: str) -> int:
    units = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
    text = text.strip().upper()
    return int(text[:-1]) * units[text[-1]] if text and text[-1] in units else int(text)


def format_duration(ns: int) -> str:
    """A duration in the form 1h2m3.5s, 39ms, 15µs."""
    if ns == 0:
        return "0s"
    sign, ns = ("-", -ns) if ns < 0 else ("", ns)

    def trim(x: float) -> str:
        return f"{x:.9f}".rstrip("0").rstrip(".")

    for unit, size in (("ns", 1), ("µs", 1000), ("ms", 1_000_000)):
        if ns < size * 1000:
            return sign + trim(ns / size) + unit
    seconds, hours = ns % (60 * 10**9) / 1e9, ns // (3600 * 10**9)
    minutes = ns // (60 * 10**9) % 60
    return sign + (f"{hours}h" if hours else "") + (f"{minutes}m" if hours or minutes else "") + trim(seconds) + "s"


def median_of(sorted_values: Column) -> Column:
    """The lower median of a sorted array."""
    return F.element_at(sorted_values, F.ceil(F.size(sorted_values) / 2).cast("int"))


