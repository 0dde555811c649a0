"""Keyed-state primitives over any table with a key, a clock and a tie-breaking sequence.

All take `key` (a list of columns), `t` (a BIGINT clock that never goes back in `seq` order) and `seq` (a total order). None gathers
rows on the driver; each shuffles once by key, and primitives with the same key share that exchange.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs it from a source tree."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def folded(df: DataFrame, key: list[str], fold: Callable[[], object], schema: str, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """Each key's rows in order through its own fold(): an object with add(row) and end(), which return rows of the schema.

    Rows are partitioned and sorted by Spark and streamed, so memory is bounded by one key's state, never by its number of rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    at = [df.columns.index(k) for k in key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                mine = tuple(row[i] for i in at)
                if state is None or mine != now:
                    out += state.end() if state is not None else ()
                    now, state = mine, fold()
                out += state.add(row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(list(state.end()), columns=names)

    importable(df.sparkSession)
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def scanned(df: DataFrame, key: list[str], fold: Callable[[], Callable[..., tuple | None]], values: list[str], new: list[T.StructField], t: str = "t", seq: str = "seq") -> DataFrame:
    """df with new columns that each key's own fold() gives of its rows in (t, seq) order: a function of t and the values that returns
    them, or None to drop the row. Streamed like folded(); all other columns stay in Arrow."""
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], *new])
    read, at = [df.columns.index(c) for c in (t, *values)], [df.columns.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in at)))
            out = []
            for mine, row in zip(keys, zip(*(batch.column(i).to_pylist() for i in read))):
                if state is None or mine != now:
                    now, state = mine, fold()
                out.append(state(*row))
            kept = batch.filter(pa.array([x is not None for x in out], pa.bool_()))
            found = list(zip(*(x for x in out if x is not None))) or [()] * len(new)
            arrays = [pa.array(list(x), _arrow(f.dataType)) for x, f in zip(found, new)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=schema.names)

    importable(df.sparkSession)
    return df.repartition(*key).sortWithinPartitions(*key, t, seq).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[kind]


def ordered(key: list[str], t: str = "t", seq: str = "seq"):
    return Window.partitionBy(*key).orderBy(t, seq)


def running_clock(df: DataFrame, ts: str, seq: str, out: str = "t", by: list[str] = ()) -> DataFrame:
    """The monotone clock: the greatest timestamp so far in seq order, within each capture (`by`)."""
    return df.withColumn(out, F.max(ts).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def window_hits(df: DataFrame, key: list[str], n: int, span: int, t: str = "t", seq: str = "seq") -> DataFrame:
    """Rows that complete n events of their key within span (inclusive), with the n-th last time as `oldest`."""
    oldest = F.col(t) if n == 1 else F.lag(t, n - 1).over(ordered(key, t, seq))
    return df.withColumn("oldest", oldest).where(F.col(t) - F.col("oldest") <= span)


def last_n(key: list[str], n: int, t: str = "t", seq: str = "seq"):
    """The frame of a key's last n rows, this one included."""
    return ordered(key, t, seq).rowsBetween(-(n - 1), 0)


def top_tag(tag: str, key: list[str], n: int, t: str = "t", seq: str = "seq") -> Column:
    """The most common tag of the last n rows, the least one on a tie."""
    tags = F.collect_list(tag).over(last_n(key, n, t, seq))
    counted = F.transform(F.array_distinct(tags), lambda x: F.struct((-F.size(F.filter(tags, lambda y: y == x))).alias("c"), x.alias("v")))
    return F.array_min(counted)["v"]


def distinct_within(df: DataFrame, key: list[str], value: str, span: int, t: str = "t", seq: str = "seq", out: str = "n_distinct", keep: str | None = None, least: int = 0) -> DataFrame:
    """out: how many values of the key were seen within span, up to and with this row (later rows of the same time don't count); keep: these
    values, sorted. Rows with fewer than `least` go. State is the values of one span, each with its last time."""

    def fold():
        seen: dict = {}  # in order of last time

        def add(now, v):
            seen.pop(v, None)
            seen[v] = now
            while now - seen[first := next(iter(seen))] > span:
                del seen[first]
            if len(seen) < least:
                return None
            return (len(seen), sorted(seen, key=lambda x: (x is not None, x))) if keep else (len(seen),)

        return add

    new = [T.StructField(out, T.LongType())] + ([T.StructField(keep, T.ArrayType(df.schema[value].dataType))] if keep else [])
    return scanned(df, key, fold, [value], new, t, seq)


def rates(df: DataFrame, key: list[str], values: dict[str, Column], span: int, slots: int = 10, t: str = "t", seq: str = "seq") -> DataFrame:
    """For each name the sum of its value (whole numbers) over the last `slots` buckets of the key's ring, this row included.

    A ring starts at the key's first event and anew when `slots` slots pass unused; its state is `slots` sums a name."""
    slot, many = max(1, span // slots), len(values)
    given = [f"__{name}" for name in values]

    def fold():
        anchor, ring, total = None, deque(), [0] * many  # ring: bucket, sums

        def add(now, *mine):
            nonlocal anchor
            bucket = None if anchor is None else (now - anchor) // slot
            if bucket is None or bucket - ring[-1][0] >= slots:
                anchor, bucket = now, 0
                ring.clear()
                total[:] = [0] * many
            if not ring or ring[-1][0] != bucket:
                ring.append((bucket, [0] * many))
            while ring[0][0] <= bucket - slots:
                for i, x in enumerate(ring.popleft()[1]):
                    total[i] -= x
            for i, x in enumerate(mine):
                ring[-1][1][i] += x or 0
                total[i] += x or 0
            return tuple(total)

        return add

    rows = df.withColumns({f"__{name}": v.cast("long") for name, v in values.items()})
    return scanned(rows, key, fold, given, [T.StructField(name, T.LongType()) for name in values], t, seq).drop(*given)


def rate(df: DataFrame, key: list[str], value: Column, span: int, slots: int = 10, t: str = "t", seq: str = "seq", out: str = "rate") -> DataFrame:
    """rates() of one value."""
    return rates(df, key, {out: value}, span, slots, t, seq)


def last_before(key: list[str], t: str, when: Column, seq: str = "seq", inclusive: bool = False) -> Column:
    """As-of: the latest t of an earlier row of the key for which `when` holds; null if none."""
    frame = ordered(key, t, seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.max(F.when(when, F.col(t))).over(frame)


def recent(key: list[str], t: str, when: Column, idle: int, seq: str = "seq") -> Column:
    """Whether such a row came before, at most idle ago."""
    return F.coalesce(F.col(t) - last_before(key, t, when, seq) <= idle, F.lit(False))


def dedup_windows(firings: DataFrame, key: list[str], window: int, t: str = "t", seq: str = "seq", payload: list[str] = ()) -> DataFrame:
    """Firings as windows: the first one opens [first, first + window); those inside only count; the next one opens another.

    One row per window: key, first_t, last_t, n, and the payload of its first firing.
    """

    def fold():
        first = None

        def add(now):
            nonlocal first
            first = now if first is None or now - first >= window else first
            return (first,)

        return add

    rows = scanned(firings.select(*dict.fromkeys([*key, t, seq, *payload])), key, fold, [], [T.StructField("__first", T.LongType())], t, seq)
    head = F.min(F.struct(F.col(t).alias("t"), F.col(seq).alias("s"), F.struct(F.lit(0).alias("none"), *payload).alias("p"))).alias("__head")
    out = rows.groupBy(*key, F.col("__first").alias("first_t")).agg(F.max(t).alias("last_t"), F.count("*").alias("n"), head)
    return out.select(*key, "first_t", "last_t", "n", *[F.col(f"__head.p.{p}").alias(p) for p in payload])


def summaries(windows: DataFrame, window: int, flush_t: Column | None = None) -> DataFrame:
    """The closing record of each window that counted more than one firing, timed at its end or at the end of input if that's earlier."""
    close = F.col("first_t") + window
    return windows.where("n > 1").withColumn("close_t", close if flush_t is None else F.least(close, flush_t))


CLOCK_RANGES = 1024


def deadline_emit(df: DataFrame, clock: DataFrame, deadline: str, t: str = "t") -> DataFrame:
    """emit_t: the first clock value at or after each row's deadline, else the last of clock and deadlines (forward as-of)."""
    due = df.select(F.col(deadline).alias("__d"), F.lit(None).cast("long").alias("__c")).distinct()
    ticks = clock.select(F.col(t).alias("__d"), F.col(t).alias("__c")).distinct()
    every = due.unionAll(ticks)
    low, high = every.agg(F.min("__d"), F.max("__d")).first()
    if low is None:
        return df.withColumn("emit_t", F.lit(None).cast("long"))
    # ranges of time: within one a window looks ahead; past its end the first tick of a later one counts
    width = (high - low) // CLOCK_RANGES + 1
    spot = F.expr(f"(__d - {low}L) div {width}L").cast("int")
    firsts = {r.at: r.tick for r in ticks.groupBy(spot.alias("at")).agg(F.min("__c").alias("tick")).collect()}  # at most CLOCK_RANGES
    later, nexts = high, [high] * CLOCK_RANGES
    for k in range(CLOCK_RANGES - 1, -1, -1):
        nexts[k] = later
        later = firsts.get(k, later)
    ahead = Window.partitionBy("__at").orderBy(F.col("__d").desc(), F.col("__c").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("__at", spot).withColumn("__tick", F.min("__c").over(ahead)).where("__c is null")
    after = F.element_at(F.from_json(F.lit(json.dumps(nexts)), "array<bigint>"), F.col("__at") + 1)
    found = found.select("__d", F.coalesce("__tick", after).alias("emit_t"))
    return df.join(found, df[deadline].eqNullSafe(found["__d"])).drop("__d")


def sessions(df: DataFrame, key: list[str], idle: int, t: str = "t", seq: str = "seq", out: str = "session") -> DataFrame:
    """out: number of the key's run of events with gaps of at most idle (0, 1, ...)."""
    gap = (F.col(t) - F.lag(t).over(ordered(key, t, seq)) > idle).cast("long")
    return df.withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn(out, F.sum("__gap").over(ordered(key, t, seq).rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")
