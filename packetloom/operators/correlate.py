"""Correlation of alerts into incidents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import incident_id, severity_rank
from .primitives import folded

#: The stage of each alert category, in order of an attack.
STAGES = {"recon": 0, "web": 1, "web-attack": 1, "evasion": 1, "credential": 1, "malware": 2, "threat-intel": 2, "exfiltration": 3, "dos": 4}


def contributions(alerts: DataFrame) -> DataFrame:
    """Two rows for each alert: its target as victim, its actor as attacker."""
    sides = F.array(F.struct(F.col("dst").alias("host"), F.lit("victim").alias("role"), F.col("src").alias("peer")), F.struct(F.col("src").alias("host"), F.lit("attacker").alias("role"), F.col("dst").alias("peer")))
    return alerts.select("*", F.explode(sides).alias("c")).select(*alerts.columns, "c.*")


def compromised_hosts(contrib: DataFrame, from_stage: int | list[int], to_stage: int | list[int], window: int) -> DataFrame:
    """Hosts that attack in the later stage at most window after being a victim in the earlier: one row per attack, with the
    latest such exploit. As-of over one ordering of the host's rows, not a join of all pairs."""
    victim = (F.col("role") == "victim") & F.col("stage").isin(from_stage)
    attack = (F.col("role") == "attacker") & F.col("stage").isin(to_stage)
    w = Window.partitionBy("host").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = contrib.withColumn("exploit_t", F.max(F.when(victim, F.col("t"))).over(w))
    return rows.where(attack & (F.col("t") - F.col("exploit_t") <= window))


def callbacks(conns: DataFrame, exploits: DataFrame, window: int) -> DataFrame:
    """Connections from an exploited host to its exploiter at most window after the exploit (src -> dst): with the latest one's time."""
    a = conns.select("t", "seq", F.col("src").alias("host"), F.col("dst").alias("peer"), F.lit(None).cast("long").alias("x"))
    b = exploits.select("t", "seq", F.col("dst").alias("host"), F.col("src").alias("peer"), F.col("t").alias("x"))
    w = Window.partitionBy("host", "peer").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = a.unionAll(b).withColumn("exploit_t", F.max("x").over(w))
    return rows.where(F.col("x").isNull() & (F.col("t") - F.col("exploit_t") <= window)).drop("x")


class _Chain:
    """The longest chain of one pair of hosts. Of each stage only the latest event counts: an earlier one is part of its chain, or out of
    reach by then. State: one entry a stage."""

    def __init__(self, gaps: Callable[[int], int]):
        self.gaps = gaps
        self.best: dict[int, tuple] = {}  # stage -> stages, events, t, set of stages, weight beside the victim

    def step(self, t: int, stage: int, extra: int = 0) -> tuple:
        """The best chain that ends here: most stages, then most events."""
        mine = (1, 1, t, frozenset([stage]), extra)
        for s, (stages, events, u, of, weight) in sorted(self.best.items()):
            if s <= stage and t - u <= self.gaps(s):
                there = (stages + (s < stage), events + 1, t, of | {stage}, weight + extra)
                mine = there if there[:2] > mine[:2] else mine
        self.best[stage] = mine
        return mine


def longest_chain(events: list[tuple[int, int]], gap: int) -> tuple[int, int]:
    """The most stages in a sequence of (t, stage) in time order that never goes back in stage, with gaps of at most gap; and its length."""
    chain = _Chain(lambda _: gap)
    return max((chain.step(t, stage)[:2] for t, stage in events), default=(0, 0))


def multi_stage(alerts: DataFrame, gap: int, min_stages: int, sid: int = 0) -> DataFrame:
    """Pairs of hosts whose alerts form a chain of at least min_stages stages."""

    class Pair:
        def __init__(self):
            self.chain, self.best, self.first = _Chain(lambda _: gap), (0, 0), None

        def add(self, row):
            self.best = max(self.best, self.chain.step(row.t, row.stage)[:2])
            self.first = row.t if self.first is None else self.first
            self.last = row
            return ()

        def end(self):
            a, b = self.last.src, self.last.dst
            return [(a, b, incident_id("multi_stage", sid, a, b), *self.best, self.first, self.last.t)] if self.best[0] >= min_stages else []

    slim = alerts.select("src", "dst", "t", "seq", "stage")
    return folded(slim, ["src", "dst"], Pair, "src string, dst string, id string, n_stages long, n_alerts long, first_t long, last_t long")


def incident_updates(states: DataFrame, key: list[str]) -> DataFrame:
    """Of the running states of incidents (n_stages, severity), those that are news: the first, and later ones with more stages or a higher severity."""
    w = Window.partitionBy(*key).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rank = severity_rank(F.col("severity"))
    rows = states.withColumn("__s", F.max("n_stages").over(w)).withColumn("__r", F.max(rank).over(w))
    return rows.where(F.col("__s").isNull() | (F.col("n_stages") > F.col("__s")) | (rank > F.col("__r"))).withColumn("kind", F.when(F.col("__s").isNull(), "incident").otherwise("incident_update")).drop("__s", "__r")


def score(alerts: DataFrame, key: list[str]) -> DataFrame:
    """The number of stages times the sum of severity weights (1 to 4)."""
    return alerts.groupBy(*key).agg(F.count_distinct("stage").alias("n_stages"), F.sum(severity_rank(F.col("severity")) + 1).alias("weight")).withColumn("score", F.col("n_stages") * F.col("weight"))


CHAINS = "src string, dst string, t long, kind string, stages array<int>, severity string, n_alerts long, extra long"


def chain_states(alerts: DataFrame, from_stages: list[int], first: int, window: int, min_stages: int) -> DataFrame:
    """Incidents of attacker and victim, and their updates: whenever the chain over most stages grows to one more, from min_stages on.

    alerts: seq, t, src, dst, stage, reliable, weight. Events of a pair are the attacker's alerts on the victim, its stage-0 alerts on
    anyone, and the victim's own reliable alerts of stages after from_stages once it has been hit by one of those. A chain never goes
    back in stage; its gaps are at most `first` after a stage-0 event, else `window`. The attacker must have a reliable alert on the victim.
    """
    pairs = alerts.where("reliable").groupBy("src", "dst").agg(F.min("t").alias("sure_t")).where("src is not null and dst is not null")
    hit = alerts.where(F.col("stage").isin(from_stages or [-1])).groupBy("src", "dst").agg(F.min("t").alias("from_t"))
    pairs = pairs.join(hit, ["src", "dst"], "left").withColumnsRenamed({"src": "x", "dst": "y"})
    own = pairs.join(alerts, F.col("x") == F.col("src")).where((F.col("dst") == F.col("y")) | (F.col("stage") == 0))
    after = max(from_stages, default=99)
    next_ = pairs.where("from_t is not null and x <> y").join(alerts.where("reliable").where(F.col("stage") > after), F.col("y") == F.col("src")).where("t >= from_t")
    slim = ["x", "y", "sure_t", "t", "seq", "stage", "weight", (F.col("dst") == F.col("y")).alias("on_victim")]
    events = own.select(*slim).unionByName(next_.select(*slim)).where("stage >= 0")

    class Pair:
        def __init__(self):
            self.chain, self.told = _Chain(lambda s: first if s == 0 else window), 0

        def add(self, e):
            stages, events, _, of, extra = self.chain.step(e.t, int(e.stage), 0 if e.on_victim else int(e.weight))
            if stages < min_stages or stages <= self.told or e.t < e.sure_t:
                return ()
            row = (e.x, e.y, e.t, "incident_update" if self.told else "incident", sorted(of), "critical" if stages >= 3 else "high", events, extra)
            self.told = stages
            return [row]

        def end(self):
            return ()

    return folded(events, ["x", "y"], Pair, CHAINS, order=("t", "stage", "seq"))


def victim_weight(incidents: DataFrame, alerts: DataFrame, victim: str, day: int = 86_400_000_000_000) -> DataFrame:
    """Adds `base`: the severity weights of all alerts on the victim in the 24 h up to each incident."""
    on = alerts.select(F.col("dst").alias("__host"), F.col("t").alias("__t"), "weight")
    rows = incidents.withColumn("__row", F.monotonically_increasing_id())
    near = rows.join(on, (F.col(victim) == F.col("__host")) & F.col("__t").between(F.col("t") - day, F.col("t")), "left")
    keep = [c for c in rows.columns if c != "__row"]
    return near.groupBy("__row", *keep).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("base")).drop("__row")
