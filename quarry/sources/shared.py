"""Tables in the folder that driver and executors share: cut lineage, and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder if the master is local; on a cluster nobody else could read that."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quarry-shared-')}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, read back; removed when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
