"""Alert logs in JSON lines: written by Spark, read with an explicit schema, followed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "type string, time string, first_seen string, last_seen string, sid int, rev int, msg string, severity string, category string, proto string, src_ip string, dst_ip string, src_port int, dst_port int, count long, kind string, details map<string,string>, _corrupt string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records of rotated files; lines that aren't valid JSON have only _corrupt."""
    return spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def follow_log(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The same as a stream of the files that appear in a folder."""
    return spark.readStream.schema(LOG).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def write_log(alerts: DataFrame, path: str, lines_per_file: int = 1_000_000) -> None:
    alerts.withColumn("type", F.lit("alert")).write.option("maxRecordsPerFile", lines_per_file).mode("append").json(path)
