"""Stateless rule predicates as Columns."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ip4_number


def address(ip: str, spec: str) -> Column:
    """An address spec on a column of IPv4 or IPv6 text: any, CIDRs, lists, negated items and a negated whole."""
    spec = spec.strip()
    negated = spec.startswith("!")
    items = [x.strip() for x in spec.lstrip("!").strip("[]").split(",") if x.strip()]
    if items == ["any"]:
        return F.lit(not negated)
    yes = [x for x in items if not x.startswith("!")]
    no = [x[1:] for x in items if x.startswith("!")]

    def holds(number: Column) -> Column:  # the address parsed once, however many items there are
        inside = _any([_network(number, x) for x in yes]) if yes else F.lit(True)
        return inside & ~_any([_network(number, x) for x in no]) if no else inside

    v6 = any(":" in x for x in items)
    v4 = any("." in x for x in items)
    none = F.lit(None)
    parsed = F.struct((ip4_number(F.col(ip)) if v4 else none.cast("long")).alias("v4"), (expand_ip6(F.col(ip)) if v6 else none.cast("string")).alias("v6"))
    out = F.coalesce(F.element_at(F.transform(F.array(parsed), holds), 1), F.lit(False))
    return ~out if negated else out


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def _network(number: Column, cidr: str) -> Column:
    if cidr == "any":
        return F.lit(True)
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        return number["v4"].between(int(net.network_address), int(net.broadcast_address))
    low, high = net.network_address.exploded, net.broadcast_address.exploded
    return number["v6"].between(low, high)


def expand_ip6(ip: Column) -> Column:
    """The full 8 x 4 digit form of an IPv6 address, which sorts like the address; null for others."""
    halves = F.split(F.lower(ip), "::")
    left = F.filter(F.split(F.element_at(halves, 1), ":"), lambda x: x != "")
    right = F.when(F.size(halves) > 1, F.filter(F.split(F.element_at(halves, -1), ":"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    full = F.concat(left, F.when(F.size(halves) > 1, gap).otherwise(F.array().cast("array<string>")), right)
    ok = (F.instr(ip, ":") > 0) & (F.size(full) == 8) & (F.size(halves) <= 2) & F.forall(full, lambda x: F.regexp_like(x, F.lit("^[0-9a-f]{1,4}$")))
    return F.when(ok, F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ":"))


def port(column: str, spec: str) -> Column:
    """any, N, N:M, N:, :M, lists and negation."""
    spec = spec.strip()
    negated = spec.startswith("!")
    items = [x.strip() for x in spec.lstrip("!").strip("[]").split(",") if x.strip()]
    if items == ["any"]:
        return F.lit(not negated)

    def one(x: str) -> Column:
        low, _, high = x.partition(":")
        return F.col(column).between(int(low or 0), int(high or 65535)) if ":" in x else F.col(column) == int(x)

    yes = [one(x) for x in items if not x.startswith("!")]
    no = [one(x[1:]) for x in items if x.startswith("!")]
    out = _any(yes) if yes else F.lit(True)
    out = F.coalesce(out & ~_any(no) if no else out, F.lit(False))
    return ~out if negated else out


FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}


def flags(spec: str, column: str = "tcp_flags") -> Column:
    """Exactly these of the six flags, at least these with +, none with 0."""
    mask = 0 if spec == "0" else sum(FLAG_BITS[x] for x in spec.rstrip("+"))
    seen = F.col(column).bitwiseAND(63)
    return F.col(column).bitwiseAND(mask) == mask if spec.endswith("+") else seen == mask


def sized(column: Column, spec: str) -> Column:
    """=N, N, <N, >N, N<>M (both ends excluded)."""
    if "<>" in spec:
        low, high = map(int, spec.split("<>"))
        return (column > low) & (column < high)
    op, n = re.fullmatch(r"([<>=]?)(\d+)", spec).groups()
    return column < int(n) if op == "<" else column > int(n) if op == ">" else column == int(n)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def contains(text: Column, literal: str, nocase: bool = False) -> Column:
    return F.contains(fold(text), F.lit(literal.translate(str.maketrans(_UPPER, _LOWER)))) if nocase else F.contains(text, F.lit(literal))


def domain(name: Column, listed: list[str]) -> Column:
    """A name that is listed or a subdomain of a listed one; case and trailing dots don't matter."""
    name = F.regexp_replace(F.lower(name), r"\.+$", "")
    return _any([(name == d.lower().rstrip(".")) | F.endswith(name, F.lit("." + d.lower().rstrip("."))) for d in listed])


class RegexError(ValueError):
    """A pattern outside the language of the rules."""


def translate_regex(pattern: str) -> str:
    r"""An RE2 pattern as one for java.util.regex with the same matches on one-byte text.

    Look-around and back-references don't exist in RE2 and are refused. $ means the very end, . everything but a newline, \s and
    \b are ASCII, case folding is Unicode.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d.isdigit() and d != "0" or d == "k":
                raise RegexError(f"back-reference in {pattern!r}")
            if d == "s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            elif d == "S" and not in_class:
                out.append(r"[^\t\n\f\r ]")
            elif d == "b" and not in_class:
                out.append(r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")
            elif d == "B" and not in_class:
                out.append(r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))")
            else:
                out.append(c + d)
            i += 2
            continue
        if in_class:
            if c == "]" and out[-1] not in ("[", "[^"):
                in_class = False
            elif c in "[&" and pattern[i : i + 2] != "[:":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 1
            else:
                out.append("[")
        elif c == "(" and re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
            raise RegexError(f"look-around in {pattern!r}")
        elif c == "(" and (m := re.match(r"\(\?([a-zA-Z-]+)([:)])", pattern[i:])):
            names = m[1].replace("i", "iu", 1) if "i" in m[1].split("-")[0] else m[1]
            out.append(f"(?{names}{m[2]}")
            i += len(m[0])
            continue
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "(?d)" + "".join(out)


def matches(text: Column, pattern: str, limit: int = 16384) -> Column:
    return F.rlike(F.substring(text, 1, limit), F.lit(translate_regex(pattern)))


def multi_rule(rules: dict[int, Column]) -> Column:
    """The ids of the rules that hold for a row, in order: all rules in one pass over the table."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(sid)) for sid, c in rules.items()]), lambda x: x.isNotNull())
