"""N-gram Jaccard join (operator 1): T-occurrence search with DivideSkip over inverted lists.

A text's set is its distinct k-word shingles (64-bit hashes). Two texts link when their Jaccard
similarity reaches num/den. T-occurrence search asks which texts stand in at least T of the
inverted lists of a query's shingles. DivideSkip sets the longest lists aside, merges the short ones,
and probes the long ones by binary search for the texts that the merge found.

Spread over a cluster, in four written steps:

1. Sets are hashed; texts with equal sets become one node (their signature). Shingles seen twice
   in one block of a task's rows are counted; the `frequent` most common ones stand last, by count, in the one
   order of all shingles (others: by hash). Any order gives the same links; this one keeps lists short.
2. Each node posts its n - T + 1 first shingles (its short lists, where T = ceil(n * num / den)): a partner must
   stand in one of them. Postings travel as packed arrays, one of a node per task however many copies it has.
   In short lists,
   postings whose length and position rule out every link are dropped. The set with the smallest share of rare shingles leads a list.
3. A leader with the members of all its lists is a block. Every linked pair shares a list, hence a block. In blocks of up to WHOLE
   members, each pair's bitmaps (parities of hashes, a bit or two for each shingle) are compared: as sets differ in no
   fewer elements than bitmaps in bits, members that differ in too many bits from all others meet by chance and go, before any text
   moves. Such chance meetings grow faster than the corpus; what is left are nearly all linked. Texts join their blocks; blocks over `chunk` shingles are dealt out in chunks, each with the leader.
4. In a chunk members are first held against the leader. Those linked with it are one component already,
   so only the others search: merge of the short lists, binary probes of long ones, exact overlap. What is left unlinked in a block
   of several chunks is dealt out anew: groups of such members search each other and groups of the rest, two groups a task, each
   pair once. Edges of a spanning forest come out; connected components follow.

Nothing is capped or sampled: steps 2 to 4 see every node, and links are exact up to 64-bit hash
collisions. The driver gets only the `frequent` shingles (16 bytes each, a fixed bound).

Components are exact; links inside a component are not all visited, so none are counted.

Defined cases: null or blank text has an empty set, n_shingles 0, and is its own component. Rows that repeat
a doc_id share one component row each; rows with a null doc_id link like others, and a component of such rows only is null.
Columns other than the two named are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .runtime import most_common, partitions, prepare, record, release, slices, written

SCAN = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("token", pa.int64()), ("seen", pa.int64()), ("bits", pa.binary())])
POST = pa.schema([("bucket", pa.int32()), ("postings", pa.binary())])
MEMBER = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
EDGE = pa.schema([("kind", pa.int8()), ("u", pa.int64()), ("v", pa.int64())])  # 0: a link; 1: block and a member that its leader doesn't link with
NAMED = pa.schema([("node", pa.int64()), ("text", pa.string())])
POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("rare", "<u2")])
BLOCK_TOKENS = 1 << 22  # shingles counted together before the rare ones among them are forgotten
FLUSH = 1 << 20  # postings packed at once
BITS = 1 << 26  # of the bitmap of wanted ids: 8 MB
WHOLE = 1 << 12  # members of a block that is thinned, at most
PAIRED = 24  # lists of up to so many postings are thinned pair by pair


def needed(n: int, m: int, num: int, den: int) -> int:
    """The least overlap with which sets of n and m elements reach num/den."""
    return -(-num * (n + m) // (num + den))


def parities(s: np.ndarray) -> bytes:
    """A bit for each residue of the set's hashes: whether an odd number of them have it. There are as many residues as elements, up
    to the next power of two. Bits in which two sets differ are no more than the elements in which they differ."""
    width = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def common() -> Iterator[pa.RecordBatch]:
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            tokens, seen = tokens[seen > 1].view(np.int64), seen[seen > 1]
            m = len(tokens)
            if m:
                none = pa.nulls(m, pa.int64())
                yield record({"kind": np.ones(m, np.int8), "doc_id": none, "n": none, "node": none, "token": tokens, "seen": seen, "bits": pa.nulls(m, pa.binary())}, SCAN)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, col in slices(batch, "text"):
                sets = textvec.shingle_sets(col, k)
                none = pa.nulls(hi - lo, pa.int64())
                yield record({"kind": np.zeros(hi - lo, np.int8), "doc_id": ids.slice(lo, hi - lo), "n": np.array([len(s) for s in sets], np.int64), "node": np.array([textvec.set_signature(s) for s in sets], np.int64), "token": none, "seen": none, "bits": [parities(s) for s in sets]}, SCAN)
                held += sets
                size += sum(map(len, sets))
                if size >= BLOCK_TOKENS:
                    yield from common()
                    held, size = [], 0
        if held:
            yield from common()

    return run


def ordered(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set in the common order (by hash, then the frequent ones by rank), and how many are not frequent."""
    if not len(frequent) or not len(s):
        return s, len(s)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    late = s[often]
    return np.concatenate([s[~often], late[np.argsort(rank[at[often]], kind="stable")]]), len(s) - len(late)


def _post(k: int, num: int, den: int, buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        posted: set[int] = set()
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            with np.errstate(over="ignore"):
                bucket = (textvec.mix(rows["token"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(rows))
            yield record({"bucket": bucket[cut], "postings": pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())}, POST)

        for batch in batches:
            for _, _, col in slices(batch, "text"):
                for s in textvec.shingle_sets(col, k):
                    n = len(s)
                    if not n or (node := textvec.set_signature(s)) in posted:
                        continue
                    if len(posted) < 1 << 20:  # beyond it copies are merely posted again
                        posted.add(node)
                    front, rare = ordered(s, frequent, rank)
                    front = front[: n - -(-num * n // den) + 1]
                    rows = np.empty(len(front), POSTING)
                    rows["token"], rows["node"], rows["n"], rows["pos"] = front, node, n, np.arange(len(front))
                    rows["rare"] = rare * 65535 // n
                    held.append(rows)
                    size += len(rows)
                if size >= FLUSH:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    return run


def _lists(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_py(), POSTING) for b in batches for x in b.column(b.schema.get_field_index("postings"))]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.lexsort((rows["node"], rows["token"]))]
        rows = rows[np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))]
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.append(False, same) | np.append(same, False)]
        if not len(rows):
            return
        # the set with the smallest share of rare shingles leads in every list it stands in, so lists of the same texts make one block
        rows = rows[np.lexsort((rows["node"], rows["rare"], rows["token"]))]
        starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
        lengths = np.diff(np.append(starts, len(rows)))
        keep = np.ones(len(rows), bool)
        for length in range(2, PAIRED + 1):  # short lists, pair by pair: nothing before a list that both stand in first is shared
            at = starts[lengths == length][:, None] + np.arange(length)
            n = rows["n"][at].astype(np.int64)
            left = n - rows["pos"][at]
            can = np.minimum(left[:, :, None], left[:, None, :]) * (num + den) >= num * (n[:, :, None] + n[:, None, :])
            can[:, np.arange(length), np.arange(length)] = False
            keep[at] = can.any(2)
        lead = np.flatnonzero(keep)  # the first that is left leads
        token = rows["token"][lead]
        first = np.append(True, token[1:] != token[:-1])[: len(token)]
        lead = lead[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))] if len(first) else lead
        block = rows["node"][lead]
        rows = rows[keep]
        order = np.lexsort((rows["node"], block))
        block, node, n = block[order], rows["node"][order], rows["n"][order]
        if len(block):
            new = np.append(True, (block[1:] != block[:-1]) | (node[1:] != node[:-1]))
            yield record({"block": block[new], "node": node[new], "n": n[new].astype(np.int64)}, MEMBER)

    return run


def thinned(block: int, rows: list[tuple[int, int, bytes]], num: int, den: int) -> list[tuple[int, int, int]]:
    """Rows (block, node, n) of the members (node, n, parities) of a block that may link with another one. Members that no chain of
    such pairs joins part into blocks of their own, each led by the old leader or the member with most partners."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    n = np.array([r[1] for r in rows], np.int64)
    widths = np.array([len(r[2]) for r in rows])
    ends = np.searchsorted(n, n * den // num, side="right")
    group, partners, first, width, table = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0, 0, None
    for i in np.flatnonzero(ends > np.arange(len(rows)) + 1).tolist():
        if widths[i] != width:
            first, width = i, int(widths[i])
            parts = [np.frombuffer(r[2], np.uint64).reshape(-1, width // 8) for r in rows[i : ends[np.searchsorted(widths, width, side="right") - 1]]]
            table = np.stack([np.bitwise_xor.reduce(x, axis=0) for x in parts])  # parities of as many residues as the smallest set has
        sizes = n[i] + n[i + 1 : ends[i]]
        differ = np.bitwise_count(table[i + 1 - first : ends[i] - first] ^ table[i - first]).sum(1, dtype=np.int64)
        fit = i + 1 + np.flatnonzero(differ <= sizes - 2 * needed(sizes, 0, num, den))
        if len(fit):
            partners[i] += len(fit)
            partners[fit] += 1
            met = np.unique(np.append(group[fit], group[i]))
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
    out = []
    for one in np.unique(group[partners > 0]):
        mine = np.flatnonzero(group == one)
        lead = next((block for i in mine if rows[i][0] == block), rows[mine[np.argmax(partners[mine])]][0])
        out += [(lead, rows[i][0], rows[i][1]) for i in mine]
    return out


def _thin(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for block, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "node", "n", "bits"))):
                if block != key:
                    found += thinned(key, rows, num, den) if rows else []
                    key, rows = block, []
                rows.append(tuple(row))
            if found:
                yield record(dict(zip(MEMBER.names, zip(*found))), MEMBER)
        if rows and (found := thinned(key, rows, num, den)):
            yield record(dict(zip(MEMBER.names, zip(*found))), MEMBER)

    return run


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def divide_skip(query: np.ndarray, index: dict[int, list[int] | np.ndarray], least: int) -> dict[int, int]:
    """Members that stand in at least `least` of the query's inverted lists, with their counts.

    The long lists set aside number least / (0.0085 * log2(longest) + 1), as in Li, Lu and Lu,
    "Efficient Merging and Filtering Algorithms for Approximate String Searches".
    """
    lists = sorted((found for t in query.tolist() if (found := index.get(t)) is not None), key=len)
    if len(lists) < least:
        return {}
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]  # the shortest is always short: aside < least
    merged = np.sort(np.concatenate(short), kind="stable")  # a merge of sorted runs: equal members meet
    edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    members, counts = merged[edge], np.diff(np.append(edge, len(merged)))
    for k, one in enumerate(long):
        fit = counts + (aside - k) >= least
        members, counts = members[fit], counts[fit]
        if not len(members):
            return {}
        if len(members) <= 8:
            for i, member in enumerate(members.tolist()):
                at = bisect_left(one, member)
                counts[i] += at < len(one) and one[at] == member
        else:
            one = np.asarray(one)
            counts = counts + (one[np.minimum(np.searchsorted(one, members), len(one) - 1)] == members)
    fit = counts >= least
    return dict(zip(members[fit].tolist(), counts[fit].tolist()))


def _index(sets: list[np.ndarray], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """The inverted lists of the wanted tokens, members by number."""
    every = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(wanted, every), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == every)
    order = hit[np.argsort(at[hit], kind="stable")]  # members stay in order within a list
    token, member = every[order], member[order]
    cut = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    return dict(zip(token[cut].tolist(), np.split(member, cut[1:]))) if len(cut) else {}


def led(sets: list[np.ndarray], num: int, den: int, lead: int) -> np.ndarray:
    """Which sets link with the leader (itself included)."""
    sizes = np.array([len(s) for s in sets])
    head = sets[lead]
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(head, every), len(head) - 1)
    shared = np.add.reduceat(head[at] == every, np.append(0, np.cumsum(sizes)[:-1]))
    return shared * (num + den) >= num * (sizes + sizes[lead])


def linked_pairs(sets: list[np.ndarray], num: int, den: int, lead: int = 0) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph on `sets`."""
    forest = Forest(len(sets))
    near = led(sets, num, den, lead)
    edges = [(lead, int(x)) for x in np.flatnonzero(near) if forest.join(lead, int(x))]
    others = np.flatnonzero(~near).tolist()
    return edges + (asked(sets, others, list(range(len(sets))), num, den, forest) if others and len(sets) > 2 else [])


def asked(sets: list[np.ndarray], asks: list[int], others: list[int], num: int, den: int, forest: Forest) -> list[tuple[int, int]]:
    """Links of the asking sets with the others, as far as they join trees of the forest."""
    index = _index([sets[o] for o in others], np.unique(np.concatenate([sets[a] for a in asks])))
    sizes = np.array([len(sets[o]) for o in others])
    return [(a, others[x]) for a in asks for x in partners(sets[a], index, sizes, num, den) if a != others[x] and forest.join(a, others[x])]


def partners(query: np.ndarray, index: dict[int, np.ndarray], sizes: np.ndarray, num: int, den: int) -> list[int]:
    """The members that the query links with (itself, if it is one)."""
    own = len(query)
    found = divide_skip(query, index, -(-num * own // den))
    return [x for x, count in found.items() if count * (num + den) >= num * (own + int(sizes[x]))]


def _search(key: tuple, rows: list[tuple[int, bool, np.ndarray]], num: int, den: int) -> list[tuple[int, int, int]]:
    """What the members of one cell say: rows of EDGE. Cells with two < 0 have the leader; in others the asking members are held
    against those of group two."""
    block, one, two, whole = key
    if len(rows) < 2:
        return []
    nodes, sets = [r[0] for r in rows], [r[2] for r in rows]
    if two >= 0:
        every = list(range(len(rows)))
        asks, others = (every, every) if one == two else ([i for i in every if rows[i][1]], [i for i in every if not rows[i][1]])
        found = asked(sets, asks, others, num, den, Forest(len(rows))) if asks and others else []
        return [(0, nodes[a], nodes[b]) for a, b in found]
    if whole:
        return [(0, nodes[a], nodes[b]) for a, b in linked_pairs(sets, num, den, nodes.index(block))]
    return [(1 - int(near), block, node) for node, near in zip(nodes, led(sets, num, den, nodes.index(block))) if node != block]


def _blocks(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "one", "two", "whole"))))
            names, asks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "asks"))
            found: list[tuple[int, int, int]] = []
            for lo, hi, col in slices(batch, "text"):
                for i, s in enumerate(textvec.shingle_sets(col, k), lo):
                    if keys[i] != key:
                        found += _search(key, rows, num, den) if rows else []
                        key, rows = keys[i], []
                    if names[i] == textvec.set_signature(s) and (not rows or rows[-1][0] != names[i]):  # else another text under the same doc_id
                        rows.append((names[i], asks[i], s))
            if found:
                yield record(dict(zip(EDGE.names, zip(*found))), EDGE)
        if rows and (found := _search(key, rows, num, den)):
            yield record(dict(zip(EDGE.names, zip(*found))), EDGE)

    return run


def _nodes_of(k: int):
    """The nodes of texts, with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, col in slices(batch, "text"):
                yield record({"node": [textvec.set_signature(s) for s in textvec.shingle_sets(col, k)], "text": col.cast(pa.string())}, NAMED)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int8(): "tinyint", pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tokens", pa.binary()), ("seen", pa.binary())])
    for batch in batches:
        yield record({c: pa.array([batch.column(batch.schema.names.index(n)).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c, n in (("tokens", "token"), ("seen", "seen"))}, schema)


def _frequent(scan: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the shingles seen most often, sorted, with their ranks by count. They reach the driver as packed arrays."""
    sums = written(scan.where("kind = 1").groupBy("token").agg(F.sum("seen").alias("seen")), "counts")
    blobs = most_common(sums, "seen", most).mapInArrow(_pack, "tokens binary, seen binary").collect()
    release(sums)
    tokens = np.concatenate([np.frombuffer(r.tokens, np.uint64) for r in blobs] or [np.zeros(0, np.uint64)])
    seen = np.concatenate([np.frombuffer(r.seen, np.int64) for r in blobs] or [np.zeros(0, np.int64)])
    del blobs
    by_token = np.argsort(tokens)
    tokens, seen = tokens[by_token], seen[by_token]
    rank = np.empty(len(tokens), np.int32)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(tokens), dtype=np.int32)
    return tokens, rank


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id isn't among ids (an exact join follows): a bitmap of `BITS` hashed ids is broadcast,
    whatever their number, so that texts nobody asks for don't travel."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    here = docs.where("doc_id is not null").withColumn("bit", bit).join(F.broadcast(maps), F.bitmap_bucket_number("bit") == F.col("bucket"))
    at = F.bitmap_bit_position("bit").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return here.where(F.getbit(byte, at % 8) == 1).select(*docs.columns)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100,
    frequent: int = 1 << 21, chunk: int = 1 << 18,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs.

    frequent: how many common shingles are ranked by count (16 bytes each on the driver and every executor).
    chunk: shingles of a block's members that one search task takes at most, times two (or 16 members, however long).
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scan = written(docs.mapInArrow(_scan(k), _ddl(SCAN)), "sets")
    shared = spark.sparkContext.broadcast(_frequent(scan, frequent))
    rows = scan.where("kind = 0").select("doc_id", "n", "node")
    reps = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))

    posted = docs.select("text").mapInArrow(_post(k, num, den, parts * 4, shared), _ddl(POST))
    met = written(posted.repartition(parts, "bucket").mapInArrow(_lists(num, den), _ddl(MEMBER)).distinct(), "met")
    counted = met.join(met.groupBy("block").agg((F.count("*") <= WHOLE).alias("thin")), "block")
    bits = scan.where("kind = 0 and n > 0").select("node", "bits").groupBy("node").agg(F.first("bits").alias("bits"))
    thin = counted.where("thin").drop("thin").join(bits.hint("merge"), "node").select("block", "node", "n", "bits")
    thin = thin.repartition(parts, "block").sortWithinPartitions("block", "node").mapInArrow(_thin(num, den), _ddl(MEMBER))
    members = written(thin.unionAll(counted.where("not thin").select("block", "node", "n")).distinct(), "members")
    release(met)

    sized = members.groupBy("block").agg(F.least(F.ceil(F.sum("n") / chunk), F.ceil(F.count("*") / 8)).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = members.join(sized, "block").withColumn("mine", mine)
    nameless = not rows.where("doc_id is null and n > 0").isEmpty()

    def searched(cells: DataFrame) -> DataFrame:
        """cells (block, node, one, two, whole, asks) with the texts of their nodes, searched cell by cell."""
        placed = cells.join(reps.hint("merge"), "node").select("block", "node", "one", "two", "whole", "asks", F.col("rep").alias("doc_id"))
        cut = placed.join(_among(docs, placed.select("doc_id")).hint("merge"), "doc_id").drop("doc_id")
        if nameless:  # nodes that have null ids only are told by their texts
            texts = docs.where("doc_id is null and text is not null").select("text").mapInArrow(_nodes_of(k), "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
            cut = cut.unionByName(placed.where("doc_id is null").drop("doc_id").join(texts, "node"))
        cut = cut.repartition(parts, "block", "one", "two").sortWithinPartitions("block", "one", "two", "node")
        return cut.select("block", "one", "two", "whole", "asks", "node", "text").mapInArrow(_blocks(k, num, den), _ddl(EDGE)).distinct()

    homes = F.when(F.col("node") == F.col("block"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("mine"))
    first = dealt.select("block", "node", F.explode(homes).alias("one"), (F.col("chunks") == 1).alias("whole")).select("*", F.lit(-1).alias("two"), F.lit(True).alias("asks"))
    found = written(searched(first), "links")
    tables = [found]
    open_ = found.where("kind = 1").select(F.col("u").alias("block"), F.col("v").alias("node"), F.lit(True).alias("open"))
    if not open_.isEmpty():
        # groups of open members meet each other and the groups of the rest; the rest need not meet each other
        many = members.where("node <> block").join(open_, ["block", "node"], "left").withColumn("open", F.coalesce("open", F.lit(False)))

        def groups(which) -> Column:
            return F.least(F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / chunk), F.ceil(F.count_if(which) / 8)).cast("int")

        counts = many.groupBy("block").agg(groups(F.col("open")).alias("asking"), groups(~F.col("open")).alias("resting")).where("asking > 0")
        own = F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.col("asking"))).otherwise(F.col("asking") + F.pmod(F.xxhash64("node"), F.greatest("resting", F.lit(1)))).cast("int")
        met = F.when(F.col("open"), F.sequence(F.lit(0), F.col("asking") + F.col("resting") - 1)).otherwise(F.sequence(F.lit(0), F.col("asking") - 1))
        pairs = many.join(counts, "block").withColumn("own", own).select("block", "node", "own", F.explode(met).alias("other"))
        cells = pairs.select("block", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.lit(False).alias("whole"), (F.col("own") <= F.col("other")).alias("asks"))
        tables.append(written(searched(cells), "links"))
    edges = tables[0] if len(tables) == 1 else tables[0].unionAll(tables[1])
    roots = components(edges.where("kind = 0").select("u", "v"))
    for df in (members, *tables):
        release(df)
    rooted = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()).join(reps, "node")
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    named = reps.join(rooted.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    full = rows.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
