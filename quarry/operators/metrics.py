"""Clustering metrics: silhouette on a bounded sample, normalised mutual information, topic coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.operators.splits import SEED, draw
from quarry.operators.tokens import term_counts
from quarry.operators.vectors import small, squared_distance
from quarry.sources.shared import materialize


def sample_exact(rows: DataFrame, n: int, id_column: str, seed: int | str = SEED) -> DataFrame:
    """n rows, uniform and the same for any partitioning (all rows if there are fewer)."""
    return rows.orderBy(draw(seed, id_column), id_column).limit(n)


def silhouette(points: DataFrame, dim: int, sample: int = 5000, id_column: str = "id") -> DataFrame:
    """One row: silhouette of at most `sample` points (id, label, embedding), null where it is undefined. Pairs are those of the sample."""
    s = sample_exact(points.where("label >= 0"), sample, id_column).select(F.col(id_column).alias("id"), "label", "embedding")
    other = small(s.select(F.col("id").alias("id2"), F.col("label").alias("label2"), F.col("embedding").alias("e2")))
    d = s.crossJoin(other).where("id <> id2").groupBy("id", "label", "label2").agg(F.avg(F.sqrt(squared_distance(F.col("embedding"), F.col("e2"), dim))).alias("d"))
    per = d.groupBy("id", "label").agg(F.min(F.when(F.col("label") == F.col("label2"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    counts = s.agg(F.count_distinct("label").alias("k"), F.count("*").alias("n"))
    return per.agg(F.avg(value).alias("v")).join(counts, F.lit(True)).select(F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("v")).alias("silhouette"), F.col("n").alias("points"))


def nmi(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the arithmetic mean of the entropies; 1 if both sides are constant."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    entropy = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("m")).join(total, F.lit(True)).agg((-F.sum(F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t")))).alias(name))
    x = cells.withColumn("_na", F.sum("n").over(Window.partitionBy(a))).withColumn("_nb", F.sum("n").over(Window.partitionBy(b))).join(total, F.lit(True))
    mi = x.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("_na") * F.col("_nb")))).alias("mi"))
    both = mi.join(entropy(a, "ha"), F.lit(True)).join(entropy(b, "hb"), F.lit(True))
    return both.select(F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).when(F.col("mi") <= 0, 0.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def supported(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """label, m of the clusters of min_docs documents or more (noise is none)."""
    return docs.where("label >= 0" if docs.schema["label"].dataType.typeName() != "string" else "label IS NOT NULL").groupBy("label").agg(F.count("*").alias("m")).where(F.col("m") >= min_docs)


def coherence(docs: DataFrame, top: int = 10, min_docs: int = 5, min_df: int = 2, features: int = 20_000) -> DataFrame:
    """label, npmi: mean normalised pointwise mutual information of the pairs of each cluster's top terms that occur together. docs: id (unique), label, text. Of a label at most top terms go on; a document's pairs are made term by term, of those alone that a label has."""
    n = docs.count()
    terms = term_counts(docs, ["id", "label"])
    # one row a label and term: all that the choice of terms needs
    each = materialize(terms.select("label", F.explode("terms").alias("x")).groupBy("label", "x.term").agg(F.sum("x.tf").alias("c"), F.count("*").alias("df")), "label-terms")
    counted = each.groupBy("term").agg(F.sum("c").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    vocabulary = counted.orderBy(F.desc("total"), "term").limit(features).select("term", "df")
    large = supported(docs, min_docs).select("label")
    per = each.select("label", "term", "c").join(large, "label").join(vocabulary, "term")
    best = materialize(per.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("c"), "term"))).where(F.col("r") <= top).select("label", "term", "df"), "best")
    # a pair counts for all its labels at once, and is counted where it is made: documents are not exchanged
    pairs = materialize(best.select("label", F.col("term").alias("a"), F.col("df").alias("d1")).join(best.select("label", F.col("term").alias("b"), F.col("df").alias("d2")), "label").where("a < b"), "pairs")
    partners = small(materialize(pairs.groupBy("a").agg(F.collect_set("b").alias("with")), "partners"))
    held = terms.select(F.col("terms.term").alias("x")).select("x", F.explode("x").alias("a")).join(partners, "a")
    together = held.select("a", F.explode(F.array_intersect("with", "x")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("co")).join(pairs, ["a", "b"])
    p = F.col("co") / n
    score = F.log(p / ((F.col("d1") / n) * (F.col("d2") / n))) / -F.log(p)
    return together.where(F.col("co") < n).groupBy("label").agg(F.avg(score).alias("npmi"))
