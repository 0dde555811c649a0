"""Queries that run each operator over the driver's tables, with the same as DuckDB SQL.

`events` stands for packets: user_id and props.k give addresses and ports, event_type the outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import correlate as C
from ..operators import detectors as D
from ..operators import feeds
from ..operators import predicates as P
from ..operators import primitives as K
from ..operators import stats

H = 3_600_000_000  # an hour in microseconds
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") else f"WITH {PACKETS_SQL}{sql}"
        return f

    return add


PACKETS_SQL = r"""p AS (SELECT event_id AS seq, epoch_us(ts) AS t, user_id, event_type, value,
  '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  '192.0.2.' || regexp_extract(props, '([0-9]+)', 1) AS dst, CAST(60 + floor(value) AS BIGINT) AS wire_len FROM events),
packets AS (SELECT *, CAST([21, 53, 80, 443, 22][CAST(k % 5 AS INT) + 1] AS BIGINT) AS dport FROM p) """


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    port = F.element_at(F.array(*[F.lit(x).cast("long") for x in (21, 53, 80, 443, 22)]), (F.pmod(k.cast("long"), F.lit(5)) + 1).cast("int"))
    return df.select(
        F.col("event_id").alias("seq"), S.micros("ts").alias("t"), "user_id", "event_type", "value",
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src"),
        k.cast("long").alias("k"), F.concat(F.lit("192.0.2."), k).alias("dst"), (60 + F.floor("value")).cast("long").alias("wire_len"), port.alias("dport"),
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- predicates

_IN = "(src_n BETWEEN 167772160 AND 167772191 OR src_n BETWEEN 167772224 AND 167772287)"
_N = "(SELECT *, list_sum(list_transform([1, 2, 3, 4], lambda i: CAST(split_part(src, '.', i) AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT))) AS src_n FROM packets)"


@query(f"SELECT seq, src FROM {_N} WHERE {_IN} AND NOT src_n BETWEEN 167772168 AND 167772171")
def match_addr_cidr(spark, sf):
    return packets(spark, sf).where(P.address("src", "[10.0.0.0/27,10.0.0.64/26,!10.0.0.8/30]")).select("seq", "src")


@query("SELECT seq, dport FROM packets WHERE NOT (dport <= 25 OR dport BETWEEN 400 AND 500)")
def match_port_ranges(spark, sf):
    return packets(spark, sf).where(P.port("dport", "![:25,400:500]")).select("seq", "dport")


@query("SELECT seq, k FROM packets WHERE (k & 63) = 18 OR (k & 3) = 3")
def match_flags_mask(spark, sf):
    return packets(spark, sf).where(P.flags("SA", "k") | P.flags("FS+", "k")).select("seq", "k")


@query("SELECT seq, wire_len FROM packets WHERE (wire_len > 70 AND wire_len < 90) OR wire_len = 61 OR wire_len > 200")
def match_dsize(spark, sf):
    c = F.col("wire_len")
    return packets(spark, sf).where(P.sized(c, "70<>90") | P.sized(c, "61") | P.sized(c, ">200")).select("seq", "wire_len")


@query(", q AS (SELECT page_id, url FROM pages) SELECT page_id, contains(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'example.com') AS hit FROM q")
def content_nocase_pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", P.contains(F.col("url"), "Example.COM", nocase=True).alias("hit"))


@query(r"SELECT doc_id, regexp_matches(left(text, 16384), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b') AS hit FROM documents")
def regex_documents_ip(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.matches(F.col("text"), r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b").alias("hit"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)\.(COM|net)/[a-z]{2}/[0-9]+$') AS hit FROM pages")
def regex_translate_pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", P.matches(F.col("url"), r"(?i)\.(COM|net)/[a-z]{2}/[0-9]+$").alias("hit"))


_HOST = "split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1)"


def _hosts(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"://([^/?]*)", 1).alias("host"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net')")
def app_domain_suffix_pages(spark, sf):
    return _hosts(spark, sf).where(P.domain(F.col("host"), ["Example.Net."])).select("page_id", "host")


@query(f"SELECT event_type, count(*) AS n FROM {_N} WHERE NOT ({_IN}) AND NOT (dport = 53 AND event_type = 'view') GROUP BY 1")
def pass_whitelist_suppress(spark, sf):
    suppressed = P.address("src", "[10.0.0.0/27,10.0.0.64/26]") | (P.port("dport", "53") & (F.col("event_type") == "view"))
    return packets(spark, sf).where(~suppressed).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(sid AS INT) AS sid, count(*) AS n FROM (SELECT unnest([CASE WHEN dport = 80 THEN 1 END, CASE WHEN wire_len > 100 THEN 2 END, CASE WHEN event_type = 'error' AND k < 50 THEN 3 END]) AS sid FROM packets) WHERE sid IS NOT NULL GROUP BY 1")
def multi_rule_scan(spark, sf):
    rules = {1: P.port("dport", "80"), 2: P.sized(F.col("wire_len"), ">100"), 3: (F.col("event_type") == "error") & (F.col("k") < 50)}
    return packets(spark, sf).select(F.explode(P.multi_rule(rules)).alias("sid")).groupBy("sid").agg(F.count("*").alias("n"))


# ---- feeds

@query(f"SELECT seq, src, CASE WHEN src_n BETWEEN 167772168 AND 167772171 THEN '10.0.0.8/30' ELSE '10.0.0.0/27' END AS indicator FROM {_N} WHERE src_n BETWEEN 167772160 AND 167772191")
def ip_feed_range_join(spark, sf):
    ranges = spark.createDataFrame([("10.0.0.0/27",), ("10.0.0.8/30",), ("198.51.100.0/24",)], "entry string")
    return feeds.ip_feed_join(packets(spark, sf).select("seq", "src"), "src", ranges)


@query(f"SELECT page_id, host, CASE WHEN ends_with('.' || host, '.example.org') THEN 'example.org' ELSE 'm.example.com' END AS indicator FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE ends_with('.' || host, '.example.org') OR ends_with('.' || host, '.m.example.com')")
def domain_feed_suffix_join(spark, sf):
    listed = spark.createDataFrame([("example.org",), ("www.example.org",), ("M.example.com.",)], "entry string")
    return feeds.domain_feed_join(_hosts(spark, sf), "host", listed)


@query("SELECT c_custkey, 'labelled' AS label FROM customer WHERE c_custkey IN (1, 17, 101)")
def hash_feed_md5_join(spark, sf):
    names = spark.createDataFrame([("Customer#000000001",), ("Customer#000000017",), ("Customer#000000101",)], "n string")
    hashes = names.select(F.upper(F.md5("n")).alias("entry"), F.lit("labelled").alias("label"))
    return feeds.hash_feed_join(read(spark, sf, "customer"), F.md5("c_name"), hashes).select("c_custkey", "label")


@query("SELECT * FROM (VALUES ('reserved', 2::BIGINT), ('not an address', 2::BIGINT), (NULL, 2::BIGINT)) v(problem, n)")
def feed_validate_reject(spark, sf):
    lines = spark.createDataFrame([("# list",), ("203.0.113.7",), ("198.51.100.0/24 # net",), ("10.1.2.3",), ("127.0.0.0/8",), ("300.1.1.1",), ("1.2.3.4/40",), ("",)], "value string")
    return feeds.parse_lines(lines, "ip").groupBy("problem").agg(F.count("*").alias("n"))


# ---- scalar functions

@query("SELECT page_id, round(entropy_, 6) AS h FROM (SELECT page_id, (SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c FROM unnest(string_split(url, '')) u(x) GROUP BY x), (SELECT CAST(length(url) AS DOUBLE) AS n)) AS entropy_ FROM pages)")
def shannon_entropy_pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.round(S.entropy(F.col("url")), 6).alias("h"))


@query("SELECT page_id, replace(replace(url, '?', '/'), '=', '=') AS decoded FROM pages")
def percent_decode_urls(spark, sf):
    coded = F.replace(F.col("url"), F.lit("?"), F.lit("%2f"))
    return read(spark, sf, "pages").select("page_id", S.percent_decode(coded).alias("decoded"))


@query("SELECT page_id, CASE WHEN contains(split_part(url, '#', 1), '?') THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS q FROM pages")
def query_string_extract(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.query_string(F.col("url")).alias("q"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def strip_port(spark, sf):
    return _hosts(spark, sf).select("page_id", S.strip_port(F.concat("host", F.lit(":8080"))).alias("host"))


@query(f"SELECT page_id, split_part({_HOST}, '.', 1) AS label FROM pages")
def left_label(spark, sf):
    return _hosts(spark, sf).select("page_id", S.left_label(F.col("host")).alias("label"))


@query(f"SELECT page_id, list_aggregate(list_slice(string_split({_HOST}, '.'), -2, -1), 'string_agg', '.') AS domain FROM pages")
def registered_domain_pages(spark, sf):
    return _hosts(spark, sf).select("page_id", S.registered_domain(F.col("host")).alias("domain"))


@query("SELECT seq, CAST((CASE WHEN k <= 32 THEN 32 WHEN k <= 64 THEN 64 ELSE 128 END) - k AS BIGINT) AS hops FROM packets")
def hop_distance_case(spark, sf):
    return packets(spark, sf).select("seq", S.hop_distance(F.col("k")).cast("long").alias("hops"))


@query("SELECT seq, ((t * 7 + k * 50000000) % 4294967296 - t * 7 % 4294967296 + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647 AS before FROM packets")
def seq_serial_compare(spark, sf):
    a, b = F.col("t") * 7 % (1 << 32), (F.col("t") * 7 + F.col("k") * 50_000_000) % (1 << 32)
    return packets(spark, sf).select("seq", S.serial_before(a, b).alias("before"))


@query("SELECT src, round(-128 * ln(greatest(128 - count(DISTINCT k), 1) / 128.0), 6) AS estimate FROM packets GROUP BY 1")
def linear_count_estimate(spark, sf):
    zeros = F.lit(128) - F.count_distinct("k")
    return packets(spark, sf).groupBy("src").agg(F.round(S.linear_count(zeros, 128), 6).alias("estimate"))


@query("SELECT seq, md5('771,' || k || '-' || dport || ',0-' || (k % 7)) AS hash FROM packets")
def ja3_like_md5(spark, sf):
    text = F.concat_ws(",", F.lit("771"), F.concat_ws("-", F.col("k").cast("string"), F.col("dport").cast("string")), F.concat(F.lit("0-"), (F.col("k") % 7).cast("string")))
    return packets(spark, sf).select("seq", F.md5(text).alias("hash"))


# ---- S1

def _s1_sql(key: str, n: int, span: int, where: str = "TRUE") -> str:
    return f"SELECT seq, {key}, t, oldest FROM (SELECT *, lag(t, {n - 1}) OVER (PARTITION BY {key} ORDER BY t, seq) AS oldest FROM packets WHERE {where}) WHERE t - oldest <= {span}"


@query(_s1_sql("src", 3, 96 * H, "event_type = 'error'"))
def detection_filter_by_src(spark, sf):
    return D.detection_filter(packets(spark, sf).where("event_type = 'error'"), "src", 3, 96 * H).select("seq", "src", "t", "oldest")


@query(_s1_sql("dst", 4, 96 * H))
def detection_filter_by_dst(spark, sf):
    return D.detection_filter(packets(spark, sf), "dst", 4, 96 * H).select("seq", "dst", "t", "oldest")


@query(", w AS (SELECT seq, src, list(event_type) OVER (PARTITION BY src ORDER BY t, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS l FROM packets) SELECT seq, src, (SELECT x FROM unnest(l) u(x) GROUP BY x ORDER BY count(*) DESC, x LIMIT 1) AS tag FROM w")
def window_top_tag(spark, sf):
    return packets(spark, sf).select("seq", "src", K.top_tag("event_type", ["src"], 7).alias("tag"))


@query("SELECT seq, src, round(avg(wire_len) OVER w, 6) AS mean_len, len(list_distinct(list(event_type) OVER w)) AS kinds FROM packets WINDOW w AS (PARTITION BY src ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def window_mean_distinct(spark, sf):
    w = K.last_n(["src"], 10)
    return packets(spark, sf).select("seq", "src", F.round(F.avg("wire_len").over(w), 6).alias("mean_len"), F.size(F.array_distinct(F.collect_list("event_type").over(w))).cast("long").alias("kinds"))


# ---- S2

def _s2_sql(key: str, value: str, n: int, span: int, where: str = "TRUE") -> str:
    return f", q AS (SELECT * FROM packets WHERE {where}) SELECT a.seq, a.{key}, count(DISTINCT b.{value}) AS n_distinct FROM q a JOIN q b ON a.{key} = b.{key} AND b.t BETWEEN a.t - {span} AND a.t AND b.seq <= a.seq GROUP BY 1, 2 HAVING count(DISTINCT b.{value}) >= {n}"


@query(_s2_sql("src", "dport", 4, 48 * H))
def port_scan(spark, sf):
    return D.distinct_scan(packets(spark, sf), ["src"], "dport", 4, 48 * H).select("seq", "src", "n_distinct")


@query(_s2_sql("src", "dst", 5, 72 * H, "dport = 80"))
def host_sweep(spark, sf):
    return D.distinct_scan(packets(spark, sf).where("dport = 80"), ["src"], "dst", 5, 72 * H).select("seq", "src", "n_distinct")


@query(", q AS (SELECT CAST(l_suppkey AS BIGINT) AS s, epoch_us(l_shipdate) AS t, l_orderkey * 8 + l_linenumber AS seq, l_returnflag AS f, l_partkey AS v FROM lineitem) SELECT s, t, max(n) AS most FROM (SELECT a.s, a.t, a.seq, count(DISTINCT b.v) AS n FROM q a JOIN q b ON a.s = b.s AND b.t BETWEEN a.t - 2592000000000 AND a.t AND (b.t < a.t OR b.seq <= a.seq) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def distinct_ties_lineitem(spark, sf):
    q = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), S.micros("l_shipdate").alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("v"))
    return K.distinct_within(q, ["s"], "v", 30 * 24 * H, out="n").groupBy("s", "t").agg(F.max("n").alias("most"))


# ---- S3

def _rate_sql(key: str, span: int, value: str, tail: str) -> str:
    slot = span // 10
    return f"""WITH RECURSIVE {PACKETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, seq) AS rn FROM packets),
f AS (SELECT {key}, rn, seq, t, t AS a FROM o WHERE rn = 1 UNION ALL SELECT o.{key}, o.rn, o.seq, o.t,
  CASE WHEN (o.t - f.a) // {slot} - (f.t - f.a) // {slot} >= 10 THEN o.t ELSE f.a END FROM f JOIN o ON o.{key} = f.{key} AND o.rn = f.rn + 1),
g AS (SELECT o.*, f.a, (o.t - f.a) // {slot} AS b FROM o JOIN f USING ({key}, rn)),
r AS (SELECT x.seq, x.{key}, CAST(sum({value}) AS BIGINT) AS rate FROM g x JOIN g y ON x.{key} = y.{key} AND x.a = y.a AND y.b BETWEEN x.b - 9 AND x.b AND y.rn <= x.rn GROUP BY 1, 2) {tail}"""


@query(_rate_sql("dst", 60 * H, "1", "SELECT seq, dst, rate FROM r WHERE rate >= 10"))
def rate_flood_packets(spark, sf):
    return D.rate_flood(packets(spark, sf), ["dst"], F.lit(1).cast("long"), 60 * H, 10).select("seq", "dst", "rate")


@query(_rate_sql("src", 60 * H, "y.wire_len", "SELECT seq, src, rate FROM r WHERE rate >= 700"))
def rate_flood_bytes(spark, sf):
    return D.rate_flood(packets(spark, sf), ["src"], F.col("wire_len"), 60 * H, 700).select("seq", "src", "rate")


_REPLY = _rate_sql("src", 60 * H, "CASE WHEN y.event_type <> 'view' THEN y.wire_len ELSE 0 END", "").replace(
    "AS rate FROM g x", "AS rate, CAST(sum(CASE WHEN y.event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS packets, CAST(sum(CASE WHEN y.event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS replies, bool_or(y.rn = x.rn AND x.event_type <> 'view') AS fwd FROM g x")


@query(_REPLY + "SELECT seq, src, rate, packets, replies FROM r WHERE fwd AND rate >= 500 AND replies <= 0.25 * packets")
def reply_ratio(spark, sf):
    rows = D.rate_flood(packets(spark, sf), ["src"], F.col("wire_len"), 60 * H, 500, replies=F.col("event_type") == "view", max_reply_ratio=0.25)
    return rows.select("seq", "src", "rate", "packets", "replies")


# ---- S4

_ASKED = ", w AS (SELECT *, max(CASE WHEN event_type = 'click' THEN t END) OVER (PARTITION BY src, dport ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_t FROM packets) "


@query(_ASKED + f"SELECT seq, src, dport, asked_t FROM w WHERE event_type = 'view' AND t - asked_t <= {48 * H}")
def recent_asof_reply(spark, sf):
    return D.solicited(packets(spark, sf), ["src", "dport"], F.col("event_type") == "click", F.col("event_type") == "view", 48 * H).select("seq", "src", "dport", "asked_t")


@query(_ASKED + f"SELECT seq, src, dport FROM w WHERE event_type = 'view' AND NOT coalesce(t - asked_t <= {48 * H}, FALSE)")
def unsolicited_antijoin(spark, sf):
    return D.unsolicited(packets(spark, sf), ["src", "dport"], F.col("event_type") == "click", F.col("event_type") == "view", 48 * H).select("seq", "src", "dport")


@query(f"SELECT seq, src FROM (SELECT *, t - lag(t) OVER (PARTITION BY src ORDER BY t, seq) AS gap FROM packets) WHERE gap IS NULL OR gap > {12 * H}")
def udp_flow_starts(spark, sf):
    return D.flow_starts(packets(spark, sf), ["src"], 12 * H).select("seq", "src")


@query(f", g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY src ORDER BY t, seq) > {12 * H} THEN 1 ELSE 0 END AS gap FROM packets), s AS (SELECT *, sum(gap) OVER (PARTITION BY src ORDER BY t, seq) AS session FROM g) SELECT src, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS first_t FROM s GROUP BY 1, 2")
def flow_sessions(spark, sf):
    return K.sessions(packets(spark, sf), ["src"], 12 * H).groupBy("src", "session").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query(", w AS (SELECT *, max(t - k * 1000000) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS now FROM packets) SELECT seq, now FROM w")
def packet_clock(spark, sf):
    return K.running_clock(packets(spark, sf).withColumn("late", F.col("t") - F.col("k") * 1_000_000).withColumn("capture", F.lit(0)), "late", "seq", "now", ["capture"]).select("seq", "now")


@query(f", d AS (SELECT seq, t + {H} AS due FROM packets WHERE event_type = 'error') SELECT d.seq, coalesce((SELECT min(t) FROM packets WHERE t >= due), (SELECT greatest((SELECT max(t) FROM packets), (SELECT max(due) FROM d)))) AS emit_t FROM d")
def deadline_emission(spark, sf):
    p = packets(spark, sf)
    return K.deadline_emit(p.where("event_type = 'error'").select("seq", (F.col("t") + H).alias("due")), p, "due").select("seq", "emit_t")


# ---- S5

_DEDUP = f"""WITH RECURSIVE {PACKETS_SQL}, hit AS (SELECT src, seq, t FROM (SELECT *, lag(t, 1) OVER (PARTITION BY src ORDER BY t, seq) AS oldest FROM packets WHERE event_type = 'error') WHERE t - oldest <= {72 * H}),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, seq) AS rn FROM hit),
f AS (SELECT src, rn, t, t AS first_t FROM o WHERE rn = 1 UNION ALL SELECT o.src, o.rn, o.t, CASE WHEN o.t - f.first_t >= {96 * H} THEN o.t ELSE f.first_t END FROM f JOIN o ON o.src = f.src AND o.rn = f.rn + 1),
w AS (SELECT src, first_t, max(t) AS last_t, count(*) AS n FROM f GROUP BY 1, 2) """


def _deduped(spark, sf):
    hits = K.window_hits(packets(spark, sf).where("event_type = 'error'"), ["src"], 2, 72 * H)
    return K.dedup_windows(hits, ["src"], 96 * H)


@query(_DEDUP + "SELECT * FROM w")
def dedup_alerts(spark, sf):
    return _deduped(spark, sf)


@query(_DEDUP + f"SELECT src, first_t, last_t, n, least(first_t + {96 * H}, (SELECT max(t) FROM packets)) AS close_t FROM w WHERE n > 1")
def dedup_summaries(spark, sf):
    end = packets(spark, sf).agg(F.max("t").alias("end_t"))
    rows = _deduped(spark, sf).crossJoin(F.broadcast(end))  # one row: the clock at the end of input
    return K.summaries(rows, 96 * H, F.col("end_t")).drop("end_t")


# ---- detectors

@query(f""", o AS (SELECT *, event_type = 'error' AS bad FROM packets WHERE event_type IN ('error', 'purchase')),
b AS (SELECT *, lag(t, 1) OVER (PARTITION BY dst ORDER BY t, seq) AS oldest FROM o WHERE bad),
c AS (SELECT b.seq, b.dst, b.t, b.oldest, (SELECT count(*) FROM o WHERE o.dst = b.dst AND NOT o.bad AND o.t >= b.oldest AND (o.t, o.seq) <= (b.t, b.seq)) AS completed,
 (SELECT count(DISTINCT x.dport) FROM b x WHERE x.dst = b.dst AND x.t BETWEEN b.t - {96 * H} AND b.t AND x.seq <= b.seq) AS ports FROM b WHERE t - oldest <= {96 * H})
SELECT seq, dst, completed, ports FROM c WHERE 2.0 / (2 + completed) >= 0.5 AND ports <= 5""")
def syn_flood_ratio(spark, sf):
    o = packets(spark, sf).where("event_type in ('error', 'purchase')")
    return D.syn_flood(o, "dst", 2, 96 * H, 0.5, 5, F.col("event_type") == "error").select("seq", "dst", "completed", "ports")


_FRAGS = ", f AS (SELECT seq, t, dst, k * 8 AS a, k * 8 + wire_len AS z FROM packets) "


@query(_FRAGS + f"SELECT DISTINCT x.seq, x.dst FROM f x JOIN f y ON x.dst = y.dst AND y.seq < x.seq AND x.t - y.t < {24 * H} AND y.a < x.z AND x.a < y.z AND NOT (y.a = x.a AND y.z = x.z)")
def frag_overlap_intervals(spark, sf):
    f = packets(spark, sf).select("seq", "t", "dst", (F.col("k") * 8).alias("a"), (F.col("k") * 8 + F.col("wire_len")).alias("z"))
    return D.fragment_overlaps(f, ["dst"], "a", "z", 24 * H).select("seq", "dst")


@query("SELECT seq, (k = 0 AND wire_len < 80) OR (k > 0 AND k < 50 AND wire_len < 90) AS tiny, k * 800 + wire_len > 65535 AS oversize FROM packets")
def frag_tiny_oversize(spark, sf):
    more = F.col("k") < 50
    return packets(spark, sf).select("seq", D.tiny_fragment(F.col("k"), more, F.col("wire_len"), 80, 90).alias("tiny"), D.oversize_fragment(F.col("k") * 800, F.col("wire_len")).alias("oversize"))


_MACS = ", m AS (SELECT seq, t, dst AS ip, CAST(user_id % 3 AS VARCHAR) AS mac FROM packets), c AS (SELECT *, lag(mac) OVER w AS old_mac, lag(t) OVER w AS lt FROM m WINDOW w AS (PARTITION BY ip ORDER BY t, seq)), d AS (SELECT seq, t, ip, mac, old_mac FROM c WHERE old_mac <> mac AND t - lt <= 172800000000) "


def _macs(spark, sf):
    return packets(spark, sf).select("seq", "t", F.col("dst").alias("ip"), (F.col("user_id") % 3).cast("string").alias("mac"))


@query(_MACS + "SELECT seq, ip, mac, old_mac FROM d")
def arp_mac_change(spark, sf):
    return D.binding_changes(_macs(spark, sf), "ip", "mac", 48 * H).select("seq", "ip", "mac", "old_mac")


@query(_MACS + f", b AS (SELECT * FROM (SELECT *, list(old_mac) OVER (PARTITION BY ip ORDER BY t, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS past FROM d) WHERE list_contains(past, mac)), l AS (SELECT *, lag(t, 2) OVER (PARTITION BY ip ORDER BY t, seq) AS oldest FROM b) SELECT seq, ip, oldest FROM l WHERE t - oldest <= {120 * H}")
def arp_flip_flop(spark, sf):
    return D.flip_flops(_macs(spark, sf), "ip", "mac", 48 * H, 3, 120 * H).select("seq", "ip", "oldest")


@query(_ASKED + f"SELECT CASE WHEN t - asked_t <= {48 * H} THEN 'matched' ELSE 'unsolicited' END AS class, count(*) AS n FROM w WHERE event_type = 'view' GROUP BY 1")
def dns_match_classify(spark, sf):
    asked = K.recent(["src", "dport"], "t", F.col("event_type") == "click", 48 * H)
    return packets(spark, sf).withColumn("class", F.when(asked, "matched").otherwise("unsolicited")).where("event_type = 'view'").groupBy("class").agg(F.count("*").alias("n"))


_AMP = _rate_sql("src", 60 * H, "CASE WHEN y.event_type = 'view' THEN y.wire_len ELSE 0 END", "").replace("AS rate FROM g x", "AS response_bytes, CAST(sum(CASE WHEN y.event_type = 'click' THEN y.wire_len ELSE 0 END) AS BIGINT) AS query_bytes FROM g x")


@query(_AMP + "SELECT * FROM r WHERE response_bytes >= 200 AND response_bytes >= 2 * query_bytes")
def amplification_ratio(spark, sf):
    rows = D.amplification(packets(spark, sf), ["src"], F.when(F.col("event_type") == "view", F.col("wire_len")).otherwise(0), F.when(F.col("event_type") == "click", F.col("wire_len")).otherwise(0), 60 * H, 200, 2.0)
    return rows.select("seq", "src", "response_bytes", "query_bytes")


@query(", n AS (SELECT page_id AS seq, page_id * 60000000 AS t, split_part(" + _HOST + ", '.', 1) AS sub, list_aggregate(list_slice(string_split(" + _HOST + ", '.'), -2, -1), 'string_agg', '.') AS domain FROM pages), d AS (SELECT a.seq, a.domain, count(DISTINCT b.sub) AS n_distinct, list(DISTINCT b.sub) AS subs FROM n a JOIN n b ON a.domain = b.domain AND b.t BETWEEN a.t - 1800000000 AND a.t GROUP BY 1, 2) SELECT seq, domain, n_distinct FROM d WHERE n_distinct >= 4 AND (SELECT avg(length(x)) FROM unnest(subs) u(x)) >= 4")
def tunnel_subdomains(spark, sf):
    n = _hosts(spark, sf).select(F.col("page_id").alias("seq"), (F.col("page_id") * 60_000_000).alias("t"), "host", F.lit("c").alias("client"))
    return D.tunnel_subdomains(n, ["client"], "host", 4, 30 * 60_000_000, 99.0, 4.0).select("seq", "domain", "n_distinct")


@query(", n AS (SELECT page_id AS seq, page_id * 60000000 AS t, page_id % 7 AS client, " + _HOST + " AS name FROM pages), e AS (SELECT *, (SELECT -sum(c / m * log2(c / m)) FROM (SELECT count(*) AS c FROM unnest(string_split(split_part(name, '.', 1), '')) u(x) GROUP BY x), (SELECT CAST(length(split_part(name, '.', 1)) AS DOUBLE) AS m)) AS h FROM n), d AS (SELECT a.seq, a.client, count(DISTINCT b.name) AS n_distinct, count(DISTINCT CASE WHEN b.h >= 1.9 THEN b.name END) AS n_random FROM e a JOIN e b ON a.client = b.client AND b.t BETWEEN a.t - 3600000000 AND a.t GROUP BY 1, 2) SELECT * FROM d WHERE n_distinct >= 5 AND n_random * 2 >= n_distinct")
def nxdomain_burst(spark, sf):
    n = _hosts(spark, sf).select(F.col("page_id").alias("seq"), (F.col("page_id") * 60_000_000).alias("t"), (F.col("page_id") % 7).alias("client"), F.col("host").alias("name"))
    return D.nxdomain_burst(n, "client", "name", 5, 60 * 60_000_000, 1.9).select("seq", "client", "n_distinct", "n_random")


_BEACON = """, s AS (SELECT *, row_number() OVER w AS n, t - lag(t) OVER w AS gap FROM packets WINDOW w AS (PARTITION BY src ORDER BY t, seq)),
l AS (SELECT *, list_sort(list_filter(list(gap) OVER (PARTITION BY src ORDER BY t, seq ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS gaps FROM s),
m AS (SELECT *, gaps[CAST(ceil(len(gaps) / 2.0) AS INT)] AS median_gap FROM l),
b AS (SELECT *, len(list_filter(gaps, lambda g: g BETWEEN median_gap * 0.2::DOUBLE AND median_gap * 1.8::DOUBLE OR g BETWEEN 2 * median_gap * 0.2::DOUBLE AND 2 * median_gap * 1.8::DOUBLE)) / CAST(len(gaps) AS DOUBLE) AS share FROM m) """


@query(_BEACON + "SELECT seq, src, n, median_gap, round(share, 6) AS share FROM b WHERE n >= 2")
def beacon_median(spark, sf):
    return D.beacon_scores(packets(spark, sf), ["src"], low=0.2, high=1.8).where("n >= 2").select("seq", "src", "n", "median_gap", F.round("share", 6).alias("share"))


@query(_BEACON + ", c AS (SELECT *, share >= 0.7 AS passed FROM b WHERE n >= 12 AND (n = 12 OR n % 8 = 0)), r AS (SELECT *, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY src ORDER BY n) AS run FROM c), i AS (SELECT *, sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY src, run ORDER BY n) AS inrun FROM r) SELECT seq, src, n FROM i WHERE passed AND inrun = 3")
def beacon_streak(spark, sf):
    return D.beacons(packets(spark, sf), ["src"], 12, 8, 3, 0.7, low=0.2, high=1.8).select("seq", "src", "n")


_TOTALS = f""", x AS (SELECT src, t - (t + 62135596800000000) % {24 * H} AS start, CAST(sum(wire_len) AS DOUBLE) AS x FROM packets GROUP BY 1, 2),
e AS (SELECT src, min(start) AS a, max(start) AS b FROM x GROUP BY 1), g AS (SELECT src, unnest(range(a, b + 1, {24 * H})) AS start FROM e),
d AS (SELECT g.src, g.start, coalesce(x.x, 0) AS x FROM g LEFT JOIN x USING (src, start)) """


@query(_TOTALS + ", o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY start) AS rn FROM d), m AS (SELECT src, avg(x) AS m FROM o WHERE rn <= 10 GROUP BY 1) SELECT o.src, round(any_value(m), 4) AS mean, round(avg(abs(x - m)), 4) AS dev FROM o JOIN m USING (src) WHERE rn <= 10 GROUP BY 1")
def baseline_learn(spark, sf):
    totals = D.interval_totals(packets(spark, sf), "src", 24 * H, F.col("wire_len"))
    first = totals.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("start"))).where("rn <= 10").withColumn("m", F.avg("x").over(Window.partitionBy("src")))
    return first.groupBy("src").agg(F.round(F.first("m"), 4).alias("mean"), F.round(F.avg(F.abs(F.col("x") - F.col("m"))), 4).alias("dev"))


@query("WITH RECURSIVE " + PACKETS_SQL + _TOTALS + """, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY start) AS rn FROM d), m AS (SELECT src, avg(x) AS m FROM o WHERE rn <= 10 GROUP BY 1),
q AS (SELECT o.src, any_value(m) AS m, avg(abs(x - m)) AS v FROM o JOIN m USING (src) WHERE rn <= 10 GROUP BY 1),
f AS (SELECT src, CAST(10 AS BIGINT) AS rn, m, v, CAST(NULL AS BIGINT) AS start, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS score FROM q
UNION ALL SELECT f.src, o.rn, CASE WHEN (o.x - f.m) / greatest(f.v, 1.0) >= 2.5 THEN f.m ELSE f.m + 0.1 * (o.x - f.m) END, CASE WHEN (o.x - f.m) / greatest(f.v, 1.0) >= 2.5 THEN f.v ELSE f.v + 0.1 * (abs(o.x - f.m) - f.v) END, o.start, o.x, (o.x - f.m) / greatest(f.v, 1.0) FROM f JOIN o ON o.src = f.src AND o.rn = f.rn + 1)
SELECT src, start, x, round(score, 4) AS score FROM f WHERE start IS NOT NULL AND score >= 2.5""")
def baseline_ewma_fire(spark, sf):
    totals = D.interval_totals(packets(spark, sf), "src", 24 * H, F.col("wire_len"))
    return D.baseline(totals, "src", 10, threshold=2.5).select("src", "start", "x", F.round("score", 4).alias("score"))


@query(f", e AS (SELECT dst, seq, t, 1 AS d FROM packets UNION ALL SELECT dst, seq, t + k * {H}, -1 FROM packets), r AS (SELECT *, sum(d) OVER (PARTITION BY dst ORDER BY t, d, seq ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT seq, dst, CAST(open AS BIGINT) AS open FROM r WHERE d = 1 AND open >= 8")
def slow_concurrent_flows(spark, sf):
    p = packets(spark, sf).select("dst", "seq", F.col("t").alias("enter"), (F.col("t") + F.col("k") * H).alias("leave"))
    return D.concurrent(p, "dst", "enter", "leave", 8).select("seq", "dst", F.col("open").cast("long").alias("open"))


@query(f"SELECT seq, src, kinds, round(mean_value, 6) AS mean_value FROM (SELECT *, len(list_distinct(list(wire_len) OVER w)) AS kinds, avg(value) OVER w AS mean_value, lag(t, 4) OVER (PARTITION BY src ORDER BY t, seq) AS oldest FROM packets WINDOW w AS (PARTITION BY src ORDER BY t, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE t - oldest <= {72 * H} AND (kinds >= 5 OR mean_value > 40)")
def tunnel_sizes(spark, sf):
    return D.tunnel_sizes(packets(spark, sf), ["src"], "wire_len", "value", 5, 72 * H, 5, 40.0).select("seq", "src", F.col("sizes").alias("kinds"), F.round("mean_entropy", 6).alias("mean_value"))


# ---- correlation

_ALERTS = ", al AS (SELECT seq, t, src, '10.0.0.' || k AS dst, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS BIGINT) AS stage, CASE WHEN k < 50 THEN 'low' WHEN k < 80 THEN 'medium' WHEN k < 95 THEN 'high' ELSE 'critical' END AS severity FROM packets WHERE event_type IN ('error', 'purchase', 'signup')) "
_CONTRIB = _ALERTS + ", co AS (SELECT *, dst AS host, 'victim' AS role, src AS peer FROM al UNION ALL SELECT *, src, 'attacker', dst FROM al) "


def alerts(spark, sf):
    k = F.col("k")
    severity = F.when(k < 50, "low").when(k < 80, "medium").when(k < 95, "high").otherwise("critical")
    stage = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0).cast("long")
    return packets(spark, sf).where("event_type in ('error', 'purchase', 'signup')").select("seq", "t", "src", F.concat(F.lit("10.0.0."), k.cast("string")).alias("dst"), stage.alias("stage"), severity.alias("severity"))


@query(_CONTRIB + "SELECT host, role, count(*) AS n, count(DISTINCT peer) AS peers FROM co GROUP BY 1, 2")
def contributions(spark, sf):
    return C.contributions(alerts(spark, sf)).groupBy("host", "role").agg(F.count("*").alias("n"), F.count_distinct("peer").alias("peers"))


@query(_CONTRIB + f", w AS (SELECT *, max(CASE WHEN role = 'victim' AND stage = 1 THEN t END) OVER (PARTITION BY host ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exploit_t FROM co) SELECT seq, host, peer, exploit_t FROM w WHERE role = 'attacker' AND stage = 2 AND t - exploit_t <= {48 * H}")
def compromised_host(spark, sf):
    return C.compromised_hosts(C.contributions(alerts(spark, sf)), 1, 2, 48 * H).select("seq", "host", "peer", "exploit_t")


@query(_ALERTS + f", x AS (SELECT * FROM al WHERE stage = 1), c AS (SELECT seq, t, src, '10.0.0.' || k AS dst FROM packets WHERE event_type = 'click') SELECT c.seq, c.src AS host, c.dst AS peer, max(x.t) AS exploit_t FROM c JOIN x ON x.dst = c.src AND x.src = c.dst AND (x.t, x.seq) < (c.t, c.seq) GROUP BY 1, 2, 3, c.t HAVING c.t - max(x.t) <= {600 * H}")
def callback_interval_join(spark, sf):
    conns = packets(spark, sf).where("event_type = 'click'").select("seq", "t", "src", F.concat(F.lit("10.0.0."), F.col("k").cast("string")).alias("dst"))
    return C.callbacks(conns, alerts(spark, sf).where("stage = 1"), 600 * H).select("seq", "host", "peer", "exploit_t")


@query(None)
def multi_stage_chain(spark, sf):
    return C.multi_stage(alerts(spark, sf), 500 * H, 2)


@query(_ALERTS + ", s AS (SELECT seq, t, src, severity, len(list_distinct(list(stage) OVER w)) AS n_stages, max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) OVER (PARTITION BY src ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM al WINDOW w AS (PARTITION BY src ORDER BY t, seq ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, max(n_stages) OVER (PARTITION BY src ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT seq, src, n_stages, CASE WHEN before IS NULL THEN 'incident' ELSE 'incident_update' END AS kind FROM u WHERE before IS NULL OR n_stages > before OR CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END > r")
def incident_updates(spark, sf):
    so_far = Window.partitionBy("src").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    states = alerts(spark, sf).withColumn("n_stages", F.size(F.collect_set("stage").over(so_far)).cast("long"))
    return C.incident_updates(states, ["src"]).select("seq", "src", "n_stages", "kind")


@query(_ALERTS + "SELECT src, count(DISTINCT stage) AS n_stages, CAST(count(DISTINCT stage) * sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS BIGINT) AS score FROM al GROUP BY 1")
def incident_score(spark, sf):
    return C.score(alerts(spark, sf), ["src"]).select("src", "n_stages", "score")


# ---- log and statistics

def _log(spark, sf):
    return alerts(spark, sf).withColumns({"type": F.lit("alert"), "sid": F.col("stage") + 1000, "category": F.lit("recon")})


@query(_ALERTS + "SELECT seq, severity FROM al WHERE severity IN ('high', 'critical')")
def log_filter_severity(spark, sf):
    return stats.log_filter(_log(spark, sf), min_severity="high").select("seq", "severity")


@query(_ALERTS + "SELECT seq, src, t FROM al WHERE starts_with(src, '10.0.0.1') AND t BETWEEN 1704300000000000 AND 1705000000000000 AND stage = 1")
def log_filter_prefix_time(spark, sf):
    return stats.log_filter(_log(spark, sf), start=1704300000000000, end=1705000000000000, src="10.0.0.1", sids=[1001], category="RECON").select("seq", "src", "t")


@query("SELECT event_type, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM packets GROUP BY 1")
def protocol_breakdown(spark, sf):
    return stats.breakdown(packets(spark, sf), "event_type", "wire_len")


def _top_sql(value: str) -> str:
    return f", s AS (SELECT t // {24 * H} AS w, src, CAST(sum({value}) AS BIGINT) AS v FROM packets GROUP BY 1, 2), b AS (SELECT w, src, sum(v) AS v FROM (SELECT * FROM s UNION ALL SELECT w + 1, src, v FROM s) WHERE w IN (SELECT w FROM s) GROUP BY 1, 2 HAVING sum(v) > 0) SELECT w, src, CAST(v AS BIGINT) AS v, rank FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v DESC, src) AS rank FROM b) WHERE rank <= 10"


@query(_top_sql("1"))
def top_talkers_packets(spark, sf):
    return stats.top_talkers(packets(spark, sf), "src", F.lit(1), 24 * H)


@query(_top_sql("wire_len"))
def top_talkers_bytes(spark, sf):
    return stats.top_talkers(packets(spark, sf), "src", F.col("wire_len"), 24 * H)


@query(_top_sql("CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"))
def top_talkers_alerts(spark, sf):
    return stats.top_talkers(packets(spark, sf), "src", F.when(F.col("event_type") == "error", 1).otherwise(0), 24 * H)


@query(f", s AS (SELECT t // {H} AS tick, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM packets GROUP BY 1) SELECT tick, packets, bytes, round(sum(packets) OVER w / 60.0::DOUBLE, 6) AS avg_packets, round(sum(bytes) OVER w / 60.0::DOUBLE, 6) AS avg_bytes FROM s WINDOW w AS (ORDER BY tick RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rate_per_second_avg60(spark, sf):
    return stats.rates(packets(spark, sf), "wire_len", H).select("tick", "packets", "bytes", F.round("avg_packets", 6).alias("avg_packets"), F.round("avg_bytes", 6).alias("avg_bytes"))


@query(_ALERTS + "SELECT seq, t, src FROM al ORDER BY t DESC, seq DESC LIMIT 200")
def recent_alerts(spark, sf):
    return stats.recent_rows(alerts(spark, sf)).select("seq", "t", "src")


@query(_ALERTS + f", l AS (SELECT src AS id, max(t) AS t, arg_max(severity, t) AS severity, arg_max(stage, t) AS score FROM al GROUP BY 1) SELECT id, t, severity, score FROM l WHERE (SELECT max(t) FROM packets) - t <= {48 * H} ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END DESC, score DESC, t DESC, id LIMIT 500")
def active_incidents(spark, sf):
    states = alerts(spark, sf).select(F.col("src").alias("id"), "t", "seq", "severity", F.col("stage").alias("score"))
    end = packets(spark, sf).agg(F.max("t")).first()[0]
    return stats.active_incidents(states, F.lit(end), 48 * H)
