"""Stratified sampling and splitting, deterministic and the same however the data is partitioned.

Random order is the SHA-1 of seed and id. Ranks within a class are exact without one task seeing a class: rows are
bucketed by the first digits of the hash, counted by class and bucket, and ranked within the bucket above the counts of
the buckets before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 42
#: Rows that a bucket of a class should have at most; how many digits that takes is read off the largest class.
BUCKET_ROWS = 50_000


def draw(seed: int | str, id_column: str = "id") -> Column:
    return F.sha1(F.concat(F.lit(str(seed)), F.col(id_column)).cast("binary"))


def ranked(rows: DataFrame, group: str, seed: int | str = SEED, id_column: str = "id") -> DataFrame:
    """rows with rank (from 1, in the order of draw, then id, within group) and size of the group."""
    largest = rows.groupBy(group).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(largest / BUCKET_ROWS, 1), 16)))
    h = rows.withColumn("_h", draw(seed, id_column)).withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    bases = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(w).alias("size"))
    local = h.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", id_column)))
    joined = local.join(bases, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb")))
    return joined.withColumn("rank", (F.col("_r") + F.col("_base")).cast("long")).drop("_h", "_b", "_g", "_bb", "_r", "_base")


def quotas(counts: DataFrame, target: int, min_count: int, minimum: int) -> DataFrame:
    """category, n, quota from category, n: the minimum for each eligible category, then shares of capacity by largest remainder.

    counts has one row a category, so its windows are over a table of categories.
    """
    every = Window.partitionBy(F.lit(1))
    e = counts.where(F.col("n") >= min_count).withColumn("_k", F.count("*").over(every))
    least = F.when(F.lit(target) < minimum * F.col("_k"), F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("_k")))).otherwise(minimum)
    e = e.withColumn("_base", F.least(least, F.col("n"))).withColumn("_cap", F.col("n") - F.col("_base"))
    e = e.withColumn("_left", F.lit(target) - F.sum("_base").over(every)).withColumn("_total", F.sum("_cap").over(every))
    e = e.withColumn("_raw", F.when((F.col("_left") > 0) & (F.col("_total") > 0), F.col("_left") * F.col("_cap") / F.col("_total")).otherwise(0.0))
    e = e.withColumn("_floor", F.least(F.col("_cap"), F.floor("_raw")))
    e = e.withColumn("_rest", F.when(F.col("_raw") > 0, F.lit(target) - F.sum(F.col("_base") + F.col("_floor")).over(every)).otherwise(0))
    open_ = F.col("_base") + F.col("_floor") < F.col("n")
    order = Window.partitionBy(open_).orderBy((F.col("_raw") - F.floor("_raw")).desc(), F.col("_cap").desc(), F.col("category").desc())
    extra = F.when(open_ & (F.row_number().over(order) <= F.col("_rest")), 1).otherwise(0)
    return e.select("category", "n", (F.col("_base") + F.col("_floor") + extra).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, target: int, min_count: int, minimum: int, group: str = "category", seed: int | str = SEED) -> DataFrame:
    counts = rows.groupBy(F.col(group).alias("category")).agg(F.count("*").alias("n"))
    wanted = quotas(counts, target, min_count, minimum).select(F.col("category").alias("_q"), "quota")
    return ranked(rows, group, seed).join(wanted, F.col(group) == F.col("_q")).where(F.col("rank") <= F.col("quota")).drop("_q", "quota", "rank", "size")


def stratified_split(rows: DataFrame, group: str = "category", seed: int | str = SEED, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """rows with split: per group train, val and the rest, halves rounded to even, each at least one where the group has three rows."""
    n_train = F.greatest(F.lit(1), F.bround(F.col("size") * train))
    n_val = F.greatest(F.lit(1), F.bround(F.col("size") * val))
    n_train = F.when((F.col("size") - n_train - n_val < 1) & (n_train > 1), n_train - 1).otherwise(n_train)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked(rows, group, seed).withColumn("split", split).drop("rank", "size")


def random_split(rows: DataFrame, seed: int | str = SEED) -> DataFrame:
    return stratified_split(rows.withColumn("_all", F.lit(1)), "_all", seed).drop("_all")


def drift(rows: DataFrame, group: str = "category") -> DataFrame:
    """split, category, share of the split and of all rows (per cent), and the absolute difference; classes that a split lacks count as 0."""
    total = rows.groupBy(group).agg(F.count("*").alias("n_all"))
    by = rows.groupBy("split", group).agg(F.count("*").alias("n"))
    sizes = by.groupBy("split").agg(F.sum("n").alias("n_split"))
    grid = total.join(sizes, F.lit(True))  # one row a class and split
    grid = grid.join(by, ["split", group], "left").withColumn("_total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    share, overall = 100 * F.coalesce("n", F.lit(0)) / F.col("n_split"), 100 * F.col("n_all") / F.col("_total")
    return grid.select("split", F.col(group).alias("category"), share.alias("split_pct"), overall.alias("global_pct"), F.abs(share - overall).alias("diff_pct"))
