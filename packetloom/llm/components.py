"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of `edges` (longs u, v) that isn't the least of its component, the least.

    The steps of Kiveris et al., "Connected Components in MapReduce and Beyond". Edge rows never
    grow in number; every round is a written table, so no round is computed twice.
    """
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(now)), "edges")
        release(now)
        now = after
        roots = now.select(F.col("v").alias("u")).distinct()
        if now.join(roots, "u", "left_semi").isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components: no end after the allowed rounds")
