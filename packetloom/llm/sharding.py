"""Sharding (operator 7) by histogram sort, in DataFrame operations only.

Rows are ordered by doc_id (null first), then by a hash of the text. The splitters that cut this order into pieces of near
equal bytes are found by counting: a first histogram of equal-width key ranges counts the exact bytes in each; ranges
that hold a wanted boundary and weigh more than the tolerance are cut into ranges of their own and counted again, until every
boundary is met within tolerance or its range is a single doc_id. Where such an id weighs more than the tolerance (null ids,
say), its range is cut by the hash in the same way. Only counts reach the driver (bins x boundaries numbers at most).
Then the rows move once. Each shard consists of `pieces` pieces or more, so that none has over PIECE_ROWS rows on average and no task
sorts a whole shard: a row's slot is the exact row count of its shard's earlier pieces plus its rank in its piece.

The law is `bytes`. Boundaries fall between keys, so rows that share doc_id and text stay together; a single huge row may exceed a
shard's share. Equal texts under different ids carry different keys, so a hot text spreads over shards like any other rows.

Defined cases: null text counts no bytes (size 16); null doc_id sorts first; an empty table gives an empty result; other columns are
carried along and may bear any name but those of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fresh, release, written

BINS = 4096
PIECE_ROWS = 1 << 20
EDGE = 1 << 61  # keys stay clear of the ends of the number line, where bin arithmetic would overflow


def splitters(keyed: DataFrame, wanted: list[float], allowed: float) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """For each of `wanted` (in order) a key such that the rows below it weigh that much, within `allowed` or as near as whole keys
    come; and of those that are not within `allowed` the single key inside of which they lie, with the bytes below it.

    keyed: columns key (long), size (long)."""
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    if low is None or not wanted:
        return [], {}
    heavy: dict[int, tuple[int, int]] = {}
    ranges = [(low, high + 1, 0)]  # first key, end, bytes below
    cuts: dict[int, int] = {}
    open_ = {i: 0 for i in range(len(wanted))}  # boundary -> its range
    while open_:
        spans = sorted({ranges[r] for r in open_.values()})
        # one pass: every open range is cut into equal bins, its rows counted
        bins = max(2, min(BINS, (BINS * 16) // len(spans)))
        starts = F.array(*[F.lit(s[0]).cast("long") for s in spans])
        ends = F.array(*[F.lit(s[1]).cast("long") for s in spans])
        steps = F.array(*[F.lit(max(1, -(-(s[1] - s[0]) // bins))).cast("long") for s in spans])
        inside = keyed.withColumn("w", F.size(F.filter(starts, lambda s: s <= F.col("key")))).where((F.col("w") > 0) & (F.col("key") < F.element_at(ends, F.greatest("w", F.lit(1)))))
        placed = inside.select("w", (F.col("key") - F.element_at(starts, F.col("w"))).alias("d"), F.element_at(steps, F.col("w")).alias("s"), "size")
        counted: dict[int, list[tuple[int, int]]] = {}
        for w, b, n in placed.groupBy("w", F.expr("d div s").alias("b")).agg(F.sum("size")).collect():  # whole numbers: keys are too large for doubles
            counted.setdefault(w - 1, []).append((b, n))
        finer: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for k, (first, end, below) in enumerate(spans):
            step, at, out = max(1, -(-(end - first) // bins)), below, []
            for b, n in sorted(counted.get(k, [])):
                out.append((first + b * step, min(end, first + (b + 1) * step), at, at + n))
                at += n
            finer[spans[k][:2]] = out
        still: dict[int, int] = {}
        cut_again: list[tuple[int, int, int]] = []
        for i, r in open_.items():
            for first, end, below, upto in finer[ranges[r][:2]]:
                if below <= wanted[i] <= upto:
                    near_low, near_high = wanted[i] - below, upto - wanted[i]
                    if min(near_low, near_high) <= allowed or end - first <= 1:
                        cuts[i] = first if near_low <= near_high else end
                        if min(near_low, near_high) > allowed:
                            heavy[i] = first, below
                    else:
                        cut_again.append((first, end, below))
                        still[i] = len(cut_again) - 1
                    break
        ranges, open_ = cut_again, still
    return [cuts[i] for i in range(len(wanted))], heavy


def cut_keys(rows: DataFrame, many: int, tolerance: float) -> list[tuple[int, int]]:
    """many - 1 keys (id, hash of the text), in order, that cut rows (key, tie, size) into pieces of near equal bytes."""
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    wanted = [total * i / many for i in range(1, many)]
    allowed = tolerance * total / many
    first, heavy = splitters(rows, wanted, allowed)
    cuts = [(k, -EDGE * 4) for k in first]  # before all rows of the id
    hot = F.col("key").isin([k for k, _ in heavy.values()] or [None])
    several = {r.key for r in rows.where(hot).groupBy("key").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a <> b").collect()} if heavy else set()
    for key, below in sorted(x for x in set(heavy.values()) if x[0] in several):
        at = [i for i, x in heavy.items() if x == (key, below)]
        mine = rows.where(F.col("key") == key).select(F.shiftright("tie", 2).alias("key"), "size")
        for i, h in zip(at, splitters(mine, [wanted[i] - below for i in at], allowed)[0]):
            cuts[i] = (key, h * 4)
    return sorted(cuts)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", pieces: int = 4, tolerance: float = 0.02) -> DataFrame:
    """Each row of docs with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    key, tie, piece = fresh(docs, "key", "tie", "piece")
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    size = (F.octet_length(text) + 16).cast("long")
    keyed = {key: F.least(F.greatest(F.coalesce(ident, F.lit(-EDGE)), F.lit(-EDGE)), F.lit(EDGE)), tie: F.xxhash64(text)}
    rows = written(docs.select(keyed[key].alias("key"), keyed[tie].alias("tie"), size.alias("size")), "sizes")
    pieces = max(pieces, -(-rows.count() // (shards * PIECE_ROWS)))
    many = shards * pieces
    cuts = cut_keys(rows, many, tolerance)

    def place(k: str, t: str) -> Column:
        if not cuts:
            return F.lit(0)
        ends = F.array(*[F.struct(F.lit(a).cast("long").alias("k"), F.lit(b).cast("long").alias("t")) for a, b in cuts])
        return F.size(F.filter(ends, lambda c: (c["k"] < F.col(k)) | (c["k"] == F.col(k)) & (c["t"] <= F.col(t)))).cast("int")

    counts = {r.p: r.n for r in rows.groupBy(place("key", "tie").alias("p")).agg(F.count("*").alias("n")).collect()}
    release(rows)
    base, at = [], 0
    for p in range(many):
        at = 0 if p % pieces == 0 else at
        base.append(at)
        at += counts.get(p, 0)
    dealt = docs.withColumns({**keyed, "size": size, "text_crc32": F.crc32(text.cast("binary")), "law": F.lit("bytes")}).withColumn(piece, place(key, tie))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), F.col(piece) + 1)
    rank = F.row_number().over(Window.partitionBy(piece).orderBy(ident.asc_nulls_first(), tie))
    out = dealt.withColumns({"shard": F.floor(F.col(piece) / pieces).cast("int"), "slot": offset + rank - 1, "grown_shard": F.lit(None).cast("int")})
    return out.drop(key, tie, piece)
