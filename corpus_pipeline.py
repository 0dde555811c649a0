"""A pipeline that prepares `documents` as training text: each stage applies one operator of packetloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents; the last adds size, text_crc32, law, shard, slot and grown_shard.

Defined cases: null or empty texts fail the quality rules, so no later stage meets them; a null lang is a language of its own, a null
source the last one; rows that repeat a doc_id stay or go together in near_duplicates; a null doc_id is never a lesser copy of another row
there. Other columns of documents are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from packetloom.llm.runtime import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of least doc_id. Rows that repeat a doc_id are one document's."""
    found = jaccard_join.jaccard_components(docs)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    # merged at every size: the ids grow with the corpus, so they are never broadcast
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to 3 times)."""
    mixed = mixing.mix(docs, weights=[1, 2, 3])
    times = F.when(F.col("__size") > 0, F.col("__taken") / F.col("__size")).otherwise(0).cast("int")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), times)).alias("__copy")).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.shard(docs, shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontaminate", decontamination), ("mixing", mixture), ("sharding", sharded),
]

#: The perplexity model of the first stage has no SQL, so the whole has none; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
