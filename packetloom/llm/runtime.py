"""Session plumbing shared by the operators: shared folder, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs it from a source tree."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/packetloom-{os.getpid()}"
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have: each name, with underscores in front as needed (compared as Spark does, by lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packetloom/{uuid.uuid4().hex}-{label}"
    if not _written:
        atexit.register(_cleanup)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._packetloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_packetloom_path", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def _cleanup() -> None:
    try:
        spark = SparkSession.getActiveSession()
        for path in _written if spark else ():
            _delete(spark, path)
    except Exception:  # the session may be gone at exit; the folder belongs to the cluster then
        return


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as a string array with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def record(batches: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a := batches[f.name], pa.Array) else pa.array(a, type=f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """Consecutive row ranges whose texts hold about `limit` bytes at most, as large_string arrays with nulls as empty
    texts; a longer text stands alone."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(name))
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    lo = 0
    while lo < len(col):
        hi = min(len(col), max(lo + 1, int(np.searchsorted(offsets, int(offsets[lo]) + limit, side="right")) - 1))
        yield lo, hi, pc.fill_null(col.slice(lo, hi - lo).cast(pa.large_string()), "")
        lo = hi
    tidy()


def tidy() -> None:
    """Give memory that a worker has freed back to the system: workers are reused, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def most_common(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of highest `column`, `most` at most; ties at the cut are left out together. Only a histogram reaches the driver."""
    from pyspark.sql import functions as F

    least, room = 0, most
    for r in sorted(counts.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.c):
        room -= r.rows
        if room < 0:
            least = r.c + 1
            break
    return counts.where(F.col(column) >= least)
