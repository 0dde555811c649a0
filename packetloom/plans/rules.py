"""The rule language: text to rules, all errors at once, and signature rules to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITIES
from ..operators import predicates as P

PROTOCOLS = ("ip", "tcp", "udp", "icmp", "arp")
FLAGLIKE = {"same_ip", "same_port", "nocase"}
META = {"msg", "sid", "rev", "severity", "category"}
SIGNATURE = {"flags", "content", "nocase", "same_ip", "same_port", "eth_dst", "itype", "icode", "ttl", "dsize", "arp_op", "app_proto", "app_field", "app_reason", "app_content", "app_domain", "regex", "ip_feed", "domain_feed", "ja3_feed", "stream_anomaly"}
#: The options that each detector takes.
DETECTORS = {
    "syn_flood": {"track", "count", "seconds", "min_incomplete_ratio", "max_distinct_ports"}, "port_scan": {"distinct_ports", "seconds"}, "host_sweep": {"distinct_hosts", "seconds"}, "ping_sweep": {"distinct_hosts", "seconds"},
    "ttl_anomaly": {"count", "seconds", "min_samples", "max_hop_diff", "scope"}, "frag_attack": {"kind", "count", "seconds", "min_size"}, "arp_spoof": {"kind", "count", "seconds"}, "udp_flood": {"track", "count", "seconds", "metric", "max_reply_ratio"},
    "icmp_flood": {"kind", "track", "count", "seconds"}, "icmp_tunnel": {"count", "seconds"}, "slowloris": {"kind", "track", "count", "seconds", "min_age", "min_rate", "min_remaining"}, "dns_spoof": {"kind", "count", "seconds"},
    "dns_amplification": {"min_bytes", "seconds", "min_ratio"}, "dns_tunnel": {"kind", "count", "seconds", "min_entropy", "min_length", "allow"}, "dns_nxdomain_burst": {"count", "seconds", "min_entropy"},
    "beacon": {"allow", "allow_addrs", "allow_ports", "min_events", "min_interval", "max_interval", "jitter", "min_fraction", "persistence"}, "baseline": {"interval", "learn_intervals", "metrics", "drop", "max_step", "min_level", "sustain", "threshold"},
    "incident": {"kind", "first_window", "from", "to", "window", "min_stages"},
}


class RuleErrors(ValueError):
    """Every problem of a rule file, by line."""

    def __init__(self, problems: list[tuple[int, str]]):
        self.problems = sorted(problems)
        super().__init__("\n".join(f"line {n}: {what}" for n, what in self.problems))


@dataclass
class Rule:
    action: str
    proto: str
    src: str
    sport: str
    both: bool
    dst: str
    dport: str
    options: list[tuple[str, str]]
    line: int = 0
    msg: str = ""
    sid: int = 0
    rev: int = 1
    severity: str = "medium"
    category: str = ""

    def get(self, key: str, default=None):
        return next((v for k, v in self.options if k == key), default)

    @property
    def detect(self) -> str | None:
        return self.get("detect")


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    bindings: dict[str, str] = field(default_factory=dict)
    feeds: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    stages: dict[str, int] = field(default_factory=dict)
    stage_names: list[str] = field(default_factory=list)


def split_options(text: str) -> list[tuple[str, str]]:
    """key:value pairs between semicolons; in quoted values, quotes and semicolons may be escaped by a backslash."""
    out, part, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and (text[i + 1] in '";' or quoted):
            part += c + text[i + 1] if quoted and text[i + 1] not in '";' else text[i + 1] if text[i + 1] == ";" else "\\" + text[i + 1]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if c == ";" and not quoted:
            if part.strip():
                key, _, value = part.strip().partition(":")
                out.append((key.strip(), value.strip()))
            part = ""
        else:
            part += c
        i += 1
    if quoted:
        raise ValueError("unclosed quotes")
    if part.strip():
        raise ValueError(f"no ; after {part.strip()!r}")
    return out


def unquote(value: str) -> str:
    return value[1:-1].replace('\\"', '"') if len(value) > 1 and value[0] == value[-1] == '"' else value


def literal(value: str) -> str:
    """A content literal with |hex| parts, as one character a byte."""
    out = []
    for i, part in enumerate(unquote(value).split("|")):
        out.append(bytes.fromhex(part).decode("latin-1") if i % 2 else part.encode().decode("latin-1"))
    return "".join(out)


def _expand(text: str, variables: dict[str, str], seen: tuple[str, ...] = ()) -> str:
    def put(m: re.Match) -> str:
        name = m[2]
        if name in seen:
            raise ValueError(f"variable {name} refers to itself")
        if name not in variables:
            raise ValueError(f"unknown variable {name}")
        value = _expand(variables[name], variables, (*seen, name))
        return value[1:] if m[1] and value.startswith("!") else m[1] + value

    return re.sub(r"(!?)\$(\w+)", put, text)


def parse(text: str) -> RuleSet:
    """All rules of a text, or RuleErrors with everything that is wrong."""
    out, problems, rules = RuleSet(), [], []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        try:
            if word == "var":
                name, _, value = rest.partition(" ")
                if not re.fullmatch(r"\w+", name) or not value.strip():
                    raise ValueError("var NAME VALUE")
                if name in out.variables:
                    raise ValueError(f"variable {name} again")
                out.variables[name] = value.strip()
            elif word == "arpbind":
                ip, hw = rest.split()
                if not re.fullmatch(r"([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", hw):
                    raise ValueError("arpbind ADDRESS MAC")
                out.bindings[ip] = hw.lower()
            elif word == "feed":
                kind, name, path, *age = rest.split()
                if kind not in ("ip", "domain", "ja3"):
                    raise ValueError(f"unknown feed kind {kind}")
                out.feeds[name] = (kind, path, age[0].removeprefix("max_age:") if age else "7d")
            elif word == "stage":
                name, cats = rest.split()
                place = len(out.stage_names)
                if place >= 16:
                    raise ValueError("over 16 stages")
                if name in out.stage_names or (set(out.stages) & set(cats.split(","))):
                    raise ValueError(f"stage {name} or one of its categories again")
                out.stage_names.append(name)
                out.stages |= {c: place for c in cats.split(",")}
            elif word in ("alert", "pass"):
                rules.append((n, line))
            else:
                raise ValueError(f"unknown word {word}")
        except ValueError as e:
            problems.append((n, str(e)))
    sids: dict[int, int] = {}
    for n, line in rules:
        try:
            rule = _rule(n, line, out)
            if rule.sid in sids:
                raise ValueError(f"sid {rule.sid} again (line {sids[rule.sid]})")
            sids[rule.sid] = n
            out.rules.append(rule)
        except ValueError as e:
            problems.append((n, str(e)))
    if problems:
        raise RuleErrors(problems)
    return out


def _rule(n: int, line: str, given: RuleSet) -> Rule:
    head, paren, body = line.partition("(")
    if not paren or not body.rstrip().endswith(")"):
        raise ValueError("no (options)")
    words = head.split()
    if len(words) != 7 or words[4] not in ("->", "<>"):
        raise ValueError("action proto src sport -> dst dport")
    if words[1] not in PROTOCOLS:
        raise ValueError(f"unknown protocol {words[1]}")
    src, sport, dst, dport = (_expand(words[i], given.variables) for i in (2, 3, 5, 6))
    rule = Rule(words[0], words[1], src, sport, words[4] == "<>", dst, dport, [], n)
    kinds = DETECTORS.get(dict(split_options(body.rstrip()[:-1])).get("detect", ""), set())
    for key, value in split_options(body.rstrip()[:-1]):
        if key not in META | SIGNATURE | {"detect", "detection_filter"} | kinds:
            raise ValueError(f"option {key} does not belong here")
        value = _expand(value, given.variables) if "$" in value and key in ("app_domain", "allow", "allow_addrs", "allow_ports") else value
        if key == "msg":
            rule.msg = unquote(value)
        elif key == "category":
            rule.category = value
        elif key in ("sid", "rev"):
            if not value.isdigit() or not 0 < int(value) < 1 << 31:
                raise ValueError(f"bad {key}")
            setattr(rule, key, int(value))
        elif key == "severity":
            if value not in SEVERITIES:
                raise ValueError(f"unknown severity {value}")
            rule.severity = value
        else:
            rule.options.append((key, value))
    if not rule.sid:
        raise ValueError("no sid")
    if rule.detect and rule.detect not in DETECTORS:
        raise ValueError(f"unknown detector {rule.detect}")
    if rule.detect and any(k in SIGNATURE - {"stream_anomaly"} for k, _ in rule.options):
        raise ValueError("a detector takes no signature options")
    if rule.detect == "incident":
        _incident(rule, given)
    for key, value in rule.options:
        if key == "regex":
            P.translate_regex(unquote(value.partition(",")[2]))
        if key.endswith("_feed") and value.split(",")[0] not in given.feeds:
            raise ValueError(f"unknown feed {value.split(',')[0]}")
        if key in ("count", "seconds", "distinct_ports", "distinct_hosts") and not (value.isdigit() and 0 < int(value) <= {"count": 100_000, "seconds": 86_400}.get(key, 1000) or rule.detect == "udp_flood" and key == "count" and value.isdigit()):
            raise ValueError(f"{key} out of range")
    return rule


def _incident(rule: Rule, given: RuleSet) -> None:
    kind = rule.get("kind")
    if kind not in ("multi_stage", "compromised_host", "callback"):
        raise ValueError(f"unknown kind {kind} of incident")
    if not given.stage_names:
        raise ValueError("incidents need stages")
    if kind != "multi_stage" and (rule.get("min_stages") or rule.get("first_window")):
        raise ValueError("min_stages and first_window belong to kind multi_stage")
    if kind != "compromised_host" and rule.get("to"):
        raise ValueError("to belongs to kind compromised_host")
    if int(rule.get("min_stages", 2)) > len(given.stage_names):
        raise ValueError("min_stages is more than the stages of the file")
    start, end = stages_of(rule, "from", given), stages_of(rule, "to", given)
    if not start and kind != "multi_stage" or kind == "compromised_host" and not end:
        raise ValueError("no stages to go from or to")
    if kind == "compromised_host" and set(start) & set(end):
        raise ValueError("from and to share a stage")


def stages_of(rule: Rule, option: str, given: RuleSet) -> list[int]:
    """Numbers of the stages that an incident rule goes from or to; by default from exploit to c2 and exfil."""
    names = rule.get(option)
    if names is None:
        return [i for i, n in enumerate(given.stage_names) if n in (("exploit",) if option == "from" else ("c2", "exfil"))]
    if missing := [n for n in names.split(",") if n.strip() not in given.stage_names]:
        raise ValueError(f"unknown stage {missing[0]}")
    return sorted(given.stage_names.index(n.strip()) for n in names.split(","))


def reads_streams(rule: Rule) -> bool:
    """Whether a rule asks for what TCP segments say together."""
    asked = {"content", "regex", "app_field", "app_reason", "app_content", "app_domain", "stream_anomaly", "domain_feed", "ja3_feed"}
    return rule.proto in ("tcp", "ip") and any(k in asked for k, _ in rule.options)


def header(rule: Rule) -> Column:
    group = F.col("g").isin("IP", "TCP", "UDP", "ICMP") if rule.proto == "ip" else F.col("g") == rule.proto.upper()
    forward = P.address("src", rule.src) & P.port("sport", rule.sport) & P.address("dst", rule.dst) & P.port("dport", rule.dport)
    if rule.both:
        forward = forward | (P.address("dst", rule.src) & P.port("dport", rule.sport) & P.address("src", rule.dst) & P.port("sport", rule.dport))
    return group & forward


def predicate(rule: Rule) -> Column:
    """Header and signature options of a rule over the packets table; feeds and detectors are left to the engine."""
    out = header(rule)
    payload, completed, messages = F.decode(F.col("payload"), "ISO-8859-1"), F.decode(F.col("app_data"), "ISO-8859-1"), []
    contents: list[list] = []
    for key, value in rule.options:
        if key == "flags":
            out = out & P.flags(value)
        elif key == "content":
            contents.append([literal(value), False])
        elif key == "nocase" and contents:
            contents[-1][1] = True
        elif key == "same_ip":
            out = out & (F.col("src") == F.col("dst"))
        elif key == "same_port":
            out = out & (F.col("sport") == F.col("dport"))
        elif key == "eth_dst":
            want = {"broadcast": F.col("eth_dst") == "ff:ff:ff:ff:ff:ff", "multicast": F.conv(F.substring("eth_dst", 2, 1), 16, 10).cast("int") % 2 == 1, "zero": F.col("eth_dst") == "00:00:00:00:00:00"}[value.lstrip("!")]
            want = F.coalesce(want, F.lit(False))
            out = out & (~want if value.startswith("!") else want)
        elif key in ("itype", "icode"):
            out = out & (F.col("icmp_type" if key == "itype" else "icmp_code") == int(value))
        elif key == "ttl":
            out = out & P.sized(F.col("ip_ttl"), value)
        elif key == "dsize":
            out = out & P.sized(F.length("payload"), value)
        elif key == "arp_op":
            out = out & (F.col("arp_op") == {"request": 1, "reply": 2}[value])
        elif key == "app_proto":
            out = out & (F.col("app_protocol") == value)
        elif key == "stream_anomaly":
            out = out & ((F.col("stream_anomaly") == value) if value else F.col("stream_anomaly").isNotNull())
        elif key == "regex" and value.startswith("data"):
            out = out & P.matches(F.coalesce(completed, payload), unquote(value.partition(",")[2]))
        elif key in ("app_field", "app_reason", "app_content", "app_domain", "regex"):
            messages.append((key, value))
    if contents:  # all of them in the segment, or all in the messages it completes
        out = out & _any_of([_all_of([P.contains(where, text, nocase) for text, nocase in contents]) for where in (payload, completed)])
    if messages:  # all of them on the same message
        out = out & F.exists("app_msgs", lambda m: _message(m, messages))
    return F.coalesce(out, F.lit(False))


def _all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])


def _message(m: Column, options: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for key, value in options:
        if key == "app_field":
            k, _, v = value.partition("=")
            out = out & (F.lower(m[k]) == unquote(v).lower())
        elif key == "app_reason":
            out = out & (m[f"{value}_reason"] != "")
        elif key == "app_content":
            k, v = value.split(",", 1)
            nocase = v.rstrip().endswith(",nocase")
            out = out & P.contains(m[k], literal(v.removesuffix(",nocase").strip()), nocase)
        elif key == "app_domain":
            k, v = value.split(",", 1)
            out = out & P.domain(m[k], v.strip("[]").split(","))
        else:
            k, v = value.split(",", 1)
            out = out & P.matches(m[k], unquote(v))
    return F.coalesce(out, F.lit(False))
