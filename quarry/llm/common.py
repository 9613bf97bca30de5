"""Helpers shared by the operators: shared storage, session-sized parallelism, hashing of ids."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.sources.shared import shared_dir

#: ASCII white space, the only separators of words in these operators.
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []

#: Whether Spark drops a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _drop(spark, path)
        except Exception:  # the session may have ended before
            return


def materialize(df: DataFrame, name: str, drop: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, and survives lost executors. Removed when the driver ends.

    drop: the write's shuffle files go as it ends, whatever the driver's garbage collector does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true" if drop else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished writes go now, not whenever the driver happens to collect its garbage: Spark drops them when what refers to them is collected."""
    for _ in range(2):  # what the first round lets go refers to the files
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def settle(make, name: str) -> DataFrame:
    """make() as a table of its own; the tables that it wrote on its way are dropped."""
    before = len(_written)
    out = materialize(make(), name)
    for spark, path in _written[before:-1]:
        _drop(spark, path)
    del _written[before:-1]
    release(out.sparkSession)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column of strings has about `most` bytes in each, one row at least: what a worker holds at once follows bytes, not rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def trim() -> None:
    """Give back to the system what a worker has freed: it may idle next to others before its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
