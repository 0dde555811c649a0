"""Mixing sources to target weights (operator 9) by subset-sum budget fitting.

A source's share of all words is set by its weight. Targets above `most` times the source are cut to that, and
the excess is shared again by weight until none is above. A source is taken whole as often as its target holds it;
the rest of the target is a budget for whole documents. Documents are counted by exact length. Each length first gives
the same share of its documents, largest remainders next, and what is left of the budget is fitted exactly by
bounded-knapsack dynamic programming over the lengths still to be had. Of each length, the documents of least seeded
hash are the ones selected, so reruns agree.

Only the counts by (source, length) meet in one task per source, never documents. Ranks within a length are counted in hash
buckets, so no window holds a whole length of a hot source.

Defined cases: null source is a source, last in order; null or blank text has size 0 and is never taken; rows that are alike in all of
id, source and text are interchangeable; an empty table gives an empty result. Other columns may bear any name but those of the four results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import prepare, written

DP_WORDS = 1 << 15  # the most words that are fitted by dynamic programming
PLAN_ROWS = 100_000  # sources whose plan is broadcast (some 60 bytes each); more are merge-joined


def targets(sizes: dict, weights: list[float], most: float) -> dict:
    """The target of each source (keys in order), from its size and its cycling weight."""
    total, names = float(sum(sizes.values())), list(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, names, total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = most * float(sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near budget as can be found."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    if budget <= 0 or not total:
        return take
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    left = budget - int((take * lengths).sum())
    for i in np.lexsort((-lengths, -(share - take))).tolist():
        if left <= DP_WORDS:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():  # rounding can leave more than the above held
        if left <= DP_WORDS:
            break
        more = min(int(counts[i] - take[i]), (left - DP_WORDS) // max(1, int(lengths[i])) + 1, left // max(1, int(lengths[i])))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    return take + knapsack(lengths, counts - take, left)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts of each length whose sum is the largest reachable within budget (bit sets, binary splitting)."""
    take = np.zeros(len(lengths), np.int64)
    usable = [i for i in range(len(lengths)) if 0 < lengths[i] <= budget and counts[i] > 0]
    full, reach, layers = (1 << (budget + 1)) - 1, 1, []
    for i in usable:
        n, part = min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:
            part = min(part, n)
            layers.append((i, part, reach))
            reach |= (reach << (part * int(lengths[i]))) & full
            n -= part
            part *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(layers):
        if not before >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _fit(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("size")
    part["take"] = fit(part["size"].to_numpy(), part["docs"].to_numpy(), int(part["budget"].iloc[0]))
    return part[["part", "size", "take"]]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", with_texts: bool = True) -> DataFrame:
    """docs (only their id as doc_id, if not with_texts) with __size, __source_size, __target and __taken (words taken, repeats counted)."""
    spark = docs.sparkSession
    prepare(spark)
    # the rows of docs travel in one column, so none of theirs can clash with those of the plan
    def sized(*row: Column) -> DataFrame:
        text = F.col(text_col).cast("string")
        return docs.select(F.struct(*row).alias("row"), words(text).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("hash"))

    lean = written(sized(F.col(id_col).cast("long").alias("doc_id")), "lengths")
    per_source = lean.groupBy("source").agg(F.sum("size").alias("n")).collect()
    order = sorted(((r["source"], r.n) for r in per_source), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets(dict(order), list(weights), most)
    plan = []
    for i, (s, n) in enumerate(order):
        whole = int(min(goal[s] // n, most)) if n else 0
        plan.append((i, s, int(n), float(goal[s]), whole, int(round(goal[s] - whole * n)) if n else 0))
    plan = spark.createDataFrame(plan, "part int, p_source string, source_size long, target double, whole int, budget long")
    plan = F.broadcast(plan) if len(order) <= PLAN_ROWS else plan.hint("merge")  # one row a source

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(plan, rows["source"].eqNullSafe(plan["p_source"])).drop("source", "p_source")

    rows = placed(lean).where("size > 0").select("part", "size", "hash", "budget")
    counts = rows.groupBy("part", "size", "budget").agg(F.count("*").alias("docs"))
    fitted = written(counts.groupBy("part").applyInPandas(_fit, "part int, size long, take long").where("take > 0"), "fit")

    # the take-th least hash of each (source, length): buckets of hashes are counted, one of them is sorted
    rows = rows.withColumn("bucket", F.shiftrightunsigned("hash", 54))
    filled = rows.groupBy("part", "size", "bucket").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("part", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = filled.withColumn("before", before).join(fitted, ["part", "size"]).where("before < take and take <= before + m").select("part", "size", "bucket", (F.col("take") - F.col("before")).alias("room"))
    near = rows.join(edge, ["part", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("part", "size", "bucket").orderBy(F.shiftrightunsigned(F.shiftleft("hash", 10), 10)))
    same = F.count("*").over(Window.partitionBy("part", "size", "bucket", "hash"))
    least = F.min("rank").over(Window.partitionBy("part", "size", "bucket", "hash"))
    rule = near.withColumn("rank", rank).withColumn("ties", same).withColumn("least", least).where("rank = room")
    # rows with a hash below the edge are in; of those that share the edge's hash, as many as fit
    rule = written(rule.select("part", "size", F.col("bucket").alias("e_bucket"), F.col("hash").alias("e_hash"), (F.col("room") - F.col("least") + 1).alias("allowed"), "ties"), "edges")

    # merged at every size: the edges grow with the corpus, so they are never broadcast
    whole = sized(*[F.col(f"`{c}`") for c in docs.columns]) if with_texts else lean
    ruled = placed(whole).join(rule.hint("merge"), ["part", "size"], "left")
    here = F.shiftrightunsigned("hash", 54)
    low, e_low = (F.shiftrightunsigned(F.shiftleft(c, 10), 10) for c in ("hash", "e_hash"))
    below = (here < F.col("e_bucket")) | ((here == F.col("e_bucket")) & (low < e_low))
    tied = F.coalesce((F.col("hash") == F.col("e_hash")) & (F.col("allowed") < F.col("ties")), F.lit(False))
    clear = ruled.where(~tied).withColumn("in", F.coalesce(below | (F.col("hash") == F.col("e_hash")), F.lit(False)))
    split = ruled.where(tied).withColumn("in", F.row_number().over(Window.partitionBy("part", "size", "hash").orderBy("hash")) <= F.col("allowed"))
    taken = (F.col("size") * (F.col("whole") + F.col("in").cast("int"))).cast("long")
    return clear.unionByName(split).select("row.*", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), taken.alias("__taken"))
