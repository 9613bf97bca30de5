"""Scans and sinks: JSON lines with decode errors, CSV, Parquet, routed and keyed writes, JSON documents."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Fields of a raw record; all others can be read with json_fields().
RAW = StructType(
    [StructField(c, StringType()) for c in ("id", "title", "abstract", "categories", "update_date", "authors", "submitter", "comments", "journal-ref", "doi", "report-no", "license")]
    + [StructField("versions", ArrayType(StructType([StructField("version", StringType()), StructField("created", StringType())]))), StructField("authors_parsed", ArrayType(ArrayType(StringType())))]
)


def resolve(candidates: Iterable[str], variable: str = "QUARRY_DATA") -> str | None:
    """The path in the environment variable, else the first candidate that exists."""
    return os.environ.get(variable) or next((p for p in candidates if Path(p).exists()), None)


def read_json_lines(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """One row a line: the fields, _corrupt_record where a line is no JSON object, and an order (file, block, position)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = lines.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    blank = F.trim("value") == ""
    return parsed.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields], F.when(blank, F.col("value")).otherwise(F.col("r._corrupt_record")).alias("_corrupt_record"), "_file", "_block", "_line")


def read_json_strict(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """Blank lines are skipped; the first bad line fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def decode_counts(lines: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, bad: lines, and those that are no JSON."""
    return lines.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.try_parse_json(value).isNull()).alias("bad"))


def json_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """field, n: top-level fields of JSON objects and the lines that have them."""
    return lines.select(F.explode(F.json_object_keys(value)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """zstd Parquet; by: one folder a value (train, val, test)."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json_document(path: str, default=None):
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else default


def write_json_document(path: str, value) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_suffix(p.suffix + ".new")
    new.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    new.replace(p)


def batches(df: DataFrame, columns: list[str], size: int = 50_000) -> Iterator[pd.DataFrame]:
    """pandas frames of at most size rows, fetched partition by partition (for consumers outside Spark)."""
    rows = df.select(*columns).toLocalIterator(prefetchPartitions=True)
    while held := list(islice(rows, size)):
        yield pd.DataFrame.from_records(held, columns=columns)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table (with its _SUCCESS file) is there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def cached(spark: SparkSession, make: Callable[[], DataFrame], root: str, *key: object, rows: int | None = None, dim: int | None = None) -> DataFrame:
    """make() as a table under root, by key (subset, split, size of the sample, ...); one that is there is used again if it has so many rows, and vectors of that dimension."""
    path = "/".join([root.rstrip("/"), *map(str, key)])
    if exists(spark, path):
        held = spark.read.parquet(path)
        first = held.select(F.size("embedding").alias("n")).first() if dim is not None else None
        if (rows is None or held.count() == rows) and (dim is None or (first and first["n"] == dim)):
            return held
    write_parquet(make(), path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """A fitted pyspark.ml model; load_model(type(model), path) gives it back."""
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    return kind.load(path)
