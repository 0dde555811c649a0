"""Threat-intelligence feeds: validated lists and their joins.

A feed is broadcast only under `BROADCAST_ROWS` expanded rows; beyond that the same equi-join is left to Spark, which shuffles.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ip4_number, parent_domains
from .predicates import expand_ip6

BROADCAST_ROWS = 2_000_000
#: Reserved networks that no feed may list.
RESERVED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
]


def _sized(feed: DataFrame) -> DataFrame:
    return F.broadcast(feed) if feed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else feed


def parse_lines(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Feed lines as entry and problem (null if good); comments and blank lines are left out. kind: ip, domain or ja3."""
    entry = F.trim(F.regexp_replace(F.regexp_replace(F.col(column), "^﻿|\r$", ""), r"#.*$", ""))
    rows = lines.select(entry.alias("entry")).where("entry <> ''")
    if kind == "ip":
        net = address_bits(F.substring_index("entry", "/", 1))
        bits = F.when(F.instr("entry", "/") > 0, F.substring_index("entry", "/", -1).try_cast("int")).otherwise(F.length(net))
        problem = F.when(net.isNull() | bits.isNull() | ~bits.between(0, F.length(net)), "not an address")
        problem = problem.when(net.startswith("0" * 80 + "1" * 16) & (F.length(net) == 128), "IPv4 in IPv6 form")
        for reserved in map(ipaddress.ip_network, RESERVED):
            first = format(int(reserved.network_address), f"0{reserved.max_prefixlen}b")[: reserved.prefixlen]
            shared = F.least(bits, F.lit(reserved.prefixlen))  # two networks overlap if the shorter prefix begins the longer one
            problem = problem.when((F.length(net) == reserved.max_prefixlen) & (net.substr(F.lit(1), shared) == F.lit(first).substr(F.lit(1), shared)), "reserved")
    elif kind == "domain":
        problem = F.when(~F.regexp_like("entry", F.lit(r"^([A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)+[A-Za-z]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.?$")), "not a domain")
    else:
        problem = F.when(~F.regexp_like(F.split("entry", r"[,\s]+")[0], F.lit("^[0-9A-Fa-f]{32}$")), "not a hash")
    return rows.withColumn("problem", problem)


def address_bits(ip: Column) -> Column:
    """An address as 32 or 128 binary digits, which begin with those of its networks; null if it isn't one."""
    v6 = F.transform(F.split(expand_ip6(ip), ":"), lambda x: F.lpad(F.conv(x, 16, 2), 16, "0"))
    return F.coalesce(F.lpad(F.conv(ip4_number(ip).cast("string"), 10, 2), 32, "0"), F.when(F.size(v6) == 8, F.array_join(v6, "")))


def ip_feed_join(df: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """Rows whose IPv4 or IPv6 address is in a CIDR of `ranges` (entry), with the longest one as indicator: an equi-join on the first bits.

    An address is tried once for each length that the feed has: 33 + 129 at most."""
    known = lambda c: F.explode(F.filter(F.array(address_bits(c)), lambda x: x.isNotNull()))  # noqa: E731  parsed once, whatever reads it
    bits = F.when(F.instr("entry", "/") > 0, F.substring_index("entry", "/", -1).cast("int")).otherwise(F.length("net"))
    nets = ranges.select("entry").distinct().select("entry", known(F.substring_index("entry", "/", 1)).alias("net")).withColumn("bits", bits)
    nets = nets.select("entry", "bits", F.length("net").alias("width"), F.expr("substring(net, 1, bits)").alias("prefix"))
    counts = nets.groupBy("width", "bits").agg(F.count("*").alias("n")).collect()  # a row for each length
    lengths = [(r.width, r.bits) for r in counts]
    nets = F.broadcast(nets) if sum(r.n for r in counts) <= BROADCAST_ROWS else nets
    widths = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(b).alias("bits")) for w, b in sorted(lengths)]) if lengths else F.array().cast("array<struct<width:int,bits:int>>")
    # the best entry of each different address, so that rows alike stay as many as they are
    own = df.select(F.col(ip).alias("__ip")).distinct().select("__ip", known(F.col("__ip")).alias("__bits"))
    tries = own.withColumn("__l", F.explode(widths)).where(F.length("__bits") == F.col("__l.width"))
    tries = tries.select("__ip", F.col("__l.width").alias("__w"), F.col("__l.bits").alias("__b"), F.expr("substring(__bits, 1, __l.bits)").alias("__p"))
    hit = tries.join(nets, (F.col("__w") == nets["width"]) & (F.col("__b") == nets["bits"]) & (F.col("__p") == nets["prefix"]))
    best = hit.groupBy("__ip").agg(F.max_by("entry", F.struct("bits", "entry")).alias("indicator"))
    return df.join(best, df[ip] == best["__ip"]).select(*[df[c] for c in df.columns], "indicator")


def domain_feed_join(df: DataFrame, name: str, domains: DataFrame) -> DataFrame:
    """Rows whose name is a listed domain or below one, with the shortest such domain as indicator."""
    listed = domains.select(F.regexp_replace(F.lower("entry"), r"\.+$", "").alias("indicator")).distinct()
    tries = df.select(F.col(name).alias("__name")).distinct().withColumn("__d", F.explode(parent_domains(F.col("__name"))))
    hit = tries.join(_sized(listed), F.col("__d") == F.col("indicator"))
    best = hit.groupBy("__name").agg(F.min_by("indicator", F.length("indicator")).alias("indicator"))
    return df.join(best, df[name] == best["__name"]).select(*[df[c] for c in df.columns], "indicator")


def hash_feed_join(df: DataFrame, digest: Column, hashes: DataFrame) -> DataFrame:
    """Rows whose hash is listed, with its label."""
    return df.withColumn("__h", F.lower(digest)).join(_sized(hashes.select(F.lower("entry").alias("__e"), "label")), F.col("__h") == F.col("__e")).drop("__h", "__e")


def stale(modified_us: Column, now_us: Column, max_age_days: int = 7) -> Column:
    """Whether a feed file is older than its allowed age (0: never)."""
    return F.lit(False) if max_age_days == 0 else now_us - modified_us > max_age_days * 86_400_000_000
