"""Cleaning: first failing reason, first-occurrence deduplication, manifest, clean projection, keep-last upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as t

SHORT = 10
#: Order of checks; the first that fails is the reason.
REASONS = ("missing_field", "duplicate_id", "duplicate_content", "short_abstract", "placeholder", "kept")


def first_of(key: list[str | Column], order: list[str | Column]) -> Column:
    """1 for the first row of a key in the order."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order))


def judged(records: DataFrame) -> DataFrame:
    """records (line_no, unique; id, title, abstract, categories) with drop_reason.

    An id counts as seen whatever becomes of its row later; content counts as seen among first rows of their ids. Both
    are minima of line_no by key, combined where the rows lie: rows with a missing field take no part, and of a hot id
    or content one row a task is exchanged. Only line numbers, keys and flags go through these, no text.
    """
    missing = (t.normalize_space("id") == "") | (t.normalize_space("title") == "") | (t.normalize_space("abstract") == "") | (t.normalize_space("categories") == "")
    light = records.where(~missing).select("line_no", t.normalize_space("id").alias("_id"), F.sha1(t.content_key("title", "abstract").cast("binary")).alias("_key"))
    first = light.groupBy("_id").agg(F.min(F.struct("line_no", "_key")).alias("_f")).select("_f.line_no", "_f._key")
    new = first.groupBy("_key").agg(F.min("line_no").alias("line_no")).select("line_no", F.lit(True).alias("_new"))
    seen = first.select("line_no", F.lit(True).alias("_first")).join(new, "line_no", "left")
    flagged = records.withColumns({"_missing": missing, "_short": t.word_count("abstract") <= SHORT, "_placeholder": t.is_placeholder("abstract")})
    reason = (
        F.when(F.col("_missing"), REASONS[0]).when(F.col("_first").isNull(), REASONS[1]).when(F.col("_new").isNull(), REASONS[2])
        .when(F.col("_short"), REASONS[3]).when(F.col("_placeholder"), REASONS[4]).otherwise(REASONS[5])
    )
    return flagged.join(seen, "line_no", "left").select(*records.columns, reason.alias("drop_reason"))


def manifest(records: DataFrame) -> DataFrame:
    return judged(records).groupBy("drop_reason").agg(F.count("*").alias("n"))


def cleaned(records: DataFrame) -> DataFrame:
    labels = t.categories("categories")
    first = t.primary_category(labels)
    return judged(records).where(F.col("drop_reason") == "kept").select(
        "line_no", t.normalize_space("id").alias("id"), t.normalize_space("title").alias("title"), t.normalize_space("abstract").alias("abstract"), t.text_input("title", "abstract").alias("text_input"),
        t.normalize_space("categories").alias("categories"), first.alias("primary_category"), t.primary_domain(first).alias("primary_domain"), t.word_count("abstract").alias("abstract_word_len"), (F.size(labels) > 1).alias("is_multilabel"),
    )


def upsert(held: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the new ones before; one a key, the last in the order. Missing columns become null."""
    both = held.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", first_of(key, [F.col("_batch").desc(), F.col(order).desc()])).where("_n = 1").drop("_n", "_batch")


def duplicate_groups(records: DataFrame, value: Column) -> DataFrame:
    """value, n, of values that occur more than once."""
    return records.groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(records: DataFrame, value: Column) -> DataFrame:
    return duplicate_groups(records, value).agg(F.count("*").alias("duplicated_values"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"))


def duplicate_examples(records: DataFrame, value: Column, top: int = 20) -> DataFrame:
    """The largest groups, each with its first row: top groups are few, so they are broadcast to the second look."""
    groups = duplicate_groups(records, value).orderBy(F.desc("n"), "value").limit(top)
    rows = records.withColumn("value", value).join(F.broadcast(groups), "value")
    return rows.groupBy("value").agg(F.first("n").alias("n"), F.min_by("id", "line_no").alias("first_id"))
