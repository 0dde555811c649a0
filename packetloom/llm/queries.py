"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, sharding, token_count, url_filter

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(many: int, of: int) -> Column:
    """Whether crc32(doc_id as text) mod `many` is `of`; a null doc_id is in no such fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % many == of, F.lit(False))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), learn=~fold(3, 1))
    return found.select("doc_id", fold(3, 1).alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path()).select("*", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.col(decontaminate.COUNTS).alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.col(decontaminate.ITEMS).alias("items"))
    ids = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~fold(4, 2))
    return found.select("doc_id", fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=[1, 2, 3], with_texts=False)
    return found.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_language_id, op3_token_counts, op4_url_filter, op5_decontaminate, op6_line_dedup, op7_sharding, op8_quality_classifier, op9_mixing, op10_quality_rules)
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)""",
    "op5_decontaminate": rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) t(i)),
g AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
h AS (SELECT r, i, n, item_id FROM g JOIN win USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY 1),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""",
}
