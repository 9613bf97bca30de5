"""Cleaning as a stream: first occurrences within a watermark, and what the batch checks reject."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text as t
from quarry.operators.clean import SHORT


def first_seen(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered as long as the watermark lags."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def valid_records(records: DataFrame) -> DataFrame:
    """Stateless checks of the batch cleaner: required fields, short and placeholder abstracts."""
    filled = [t.normalize_space(c) != "" for c in ("id", "title", "abstract", "categories")]
    return records.where(filled[0] & filled[1] & filled[2] & filled[3] & (t.word_count("abstract") > SHORT) & ~t.is_placeholder("abstract"))


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
