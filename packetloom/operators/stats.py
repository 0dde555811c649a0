"""Traffic statistics and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank


def log_filter(log: DataFrame, kind: str = "alert", min_severity: str | None = None, start: int | None = None, end: int | None = None, src: str | None = None, dst: str | None = None, sids: list[int] | None = None, category: str | None = None) -> DataFrame:
    """Log records of a type that pass all given filters (bounds inclusive, addresses by prefix, category in any case)."""
    out = log.where(F.col("type") == kind)
    if min_severity:
        out = out.where(severity_rank(F.col("severity")) >= ["low", "medium", "high", "critical"].index(min_severity))
    for cond, given in ((lambda: F.col("t") >= start, start), (lambda: F.col("t") <= end, end), (lambda: F.startswith("src", F.lit(src)), src), (lambda: F.startswith("dst", F.lit(dst)), dst), (lambda: F.col("sid").isin(sids), sids), (lambda: F.lower("category") == category.lower(), category)):
        if given is not None:
            out = out.where(cond())
    return out


def breakdown(df: DataFrame, by: str, size: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"))


def top_talkers(df: DataFrame, host: str, value: Column, window: int, n: int = 10) -> DataFrame:
    """The n hosts of the highest value in each pair of adjoining windows (the current and the one before), ties by host; zeros are left out."""
    sums = df.groupBy(F.floor(F.col("t") / window).alias("w"), host).agg(F.sum(value).cast("long").alias("v"))
    both = sums.unionAll(sums.select((F.col("w") + 1).alias("w"), host, "v")).join(sums.select("w").distinct(), "w", "left_semi").groupBy("w", host).agg(F.sum("v").alias("v")).where("v > 0")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("v"), host))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def rates(df: DataFrame, size: str, tick: int, ticks: int = 60) -> DataFrame:
    """Packets and bytes of each tick that has any, and their means over the last `ticks` ticks (empty ones count as 0)."""
    sums = df.groupBy(F.floor(F.col("t") / tick).alias("tick")).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"))
    last = Window.orderBy("tick").rangeBetween(-(ticks - 1), 0)  # one row a tick, not a packet
    return sums.select("tick", "packets", "bytes", (F.sum("packets").over(last) / ticks).alias("avg_packets"), (F.sum("bytes").over(last) / ticks).alias("avg_bytes"))


def recent_rows(df: DataFrame, n: int = 200) -> DataFrame:
    return df.orderBy(F.desc("t"), F.desc("seq")).limit(n)


def active_incidents(states: DataFrame, now: Column, idle: int, most: int = 500) -> DataFrame:
    """The latest state of each incident that isn't idle, worst first."""
    last = states.groupBy("id").agg(F.max_by(F.struct("t", "severity", "score"), F.struct("t", "seq")).alias("s")).select("id", "s.*")
    return last.where(now - F.col("t") <= idle).orderBy(severity_rank(F.col("severity")).desc(), F.desc("score"), F.desc("t"), "id").limit(most)


def alert_line(time: str = "time") -> Column:
    """One line of text for an alert."""
    return F.concat_ws(" ", F.col(time), F.upper("severity"), F.concat(F.lit("["), F.col("sid").cast("string"), F.lit("]")), F.regexp_replace("msg", r"\p{Cc}", "?"), F.col("src"), F.lit("->"), F.col("dst"))
