"""Report tables and documents: status of expected pipelines, metric rows, best configurations, stage runtimes, search results, summaries, findings, risks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text as t
from quarry.operators.clean import upsert
from quarry.operators.metrics import sample_exact


def pipeline_status(expected: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """expected (key, enabled) with ran, success and reason_skipped, from runs (key, ok)."""
    j = expected.join(runs, key, "left")
    ok = F.col("ok")
    reason = F.when(~F.col("enabled"), "disabled by default").when(ok.isNull(), "not run").when(~ok, "failed").otherwise("")
    return j.select(*key, "enabled", ok.isNotNull().alias("ran"), F.coalesce(ok, F.lit(False)).alias("success"), reason.alias("reason_skipped"))


def sorted_metrics(metrics: DataFrame, by: tuple[str, ...] = ("nmi", "npmi", "silhouette")) -> DataFrame:
    return metrics.orderBy(*[F.desc_nulls_last(c) for c in by if c in metrics.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sampled(rows: DataFrame, labels: DataFrame, n: int, key: str = "id") -> DataFrame:
    """At most n rows, drawn by hash, with their labels: what topic coherence reads of a large subset."""
    return sample_exact(rows, n, key).join(labels, key)


def label_counts(labels: DataFrame, by: list[str], label: str = "cluster") -> DataFrame:
    """by, validation_label_count, test_label_count: distinct labels of either split."""
    of = lambda s: F.count_distinct(F.when(F.col("split") == s, F.col(label)))
    return labels.groupBy(*by).agg(of("val").alias("validation_label_count"), of("test").alias("test_label_count"))


def metrics_rows(measured: DataFrame, counts: DataFrame, by: list[str], sample: int) -> DataFrame:
    """Rows of the metrics table: measured (by, subset_size and metrics) with counts of labels, success, and a note where coherence was read off a sample."""
    note = F.when(F.col("subset_size") > sample, F.lit(f"npmi of {sample} sampled test documents")).otherwise("")
    return measured.join(counts, by, "left").withColumns({"ran_successfully": F.lit(True), "notes": note})


def with_category_ratio(metrics: DataFrame, subsets: DataFrame) -> DataFrame:
    """metrics (subset_name, test_label_count) with cluster_to_category_ratio: clusters found on the test split over the categories of the subset (subset_name, category_count)."""
    return metrics.join(subsets.select("subset_name", "category_count"), "subset_name", "left").withColumn("cluster_to_category_ratio", F.col("test_label_count") / F.col("category_count"))


def best_configs(held: DataFrame, found: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The best configuration of each key after new search rows: the highest score, the first in the order of equals. Rows of found replace those of held with the same key and order."""
    both = upsert(held, found, [*key, order], score)
    return both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in key]), F.struct(score, -F.col(order))).alias("_b")).select(*key, "_b.*")


def stage_runtimes(embedding: DataFrame, clustering: DataFrame, retrieval: DataFrame) -> DataFrame:
    """One table of metadata records (stage_name, subset_name, runtime_seconds; others if they have them) of the three kinds of stages."""
    return union_all([df.withColumn("stage_type", F.lit(k)) for k, df in (("embedding", embedding), ("clustering", clustering), ("retrieval", retrieval))])


def search_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Search tables of all stages: CSV files under .../<embedding>_<clustering>/<subset>/<file>, with what their paths say, the pipeline's label and the parameter's."""
    rows = spark.read.option("header", True).schema(schema).csv(pattern).withColumn("_path", F.split(F.col("_metadata.file_path"), "/"))
    stage = F.element_at("_path", -3)
    return rows.select(
        *[c for c in rows.columns if c != "_path"], F.substring_index(stage, "_", 1).alias("embedding"), F.regexp_replace(stage, "^[^_]*_", "").alias("clustering"), F.element_at("_path", -2).alias("subset_name"),
    ).withColumns({"pipeline": t.pipeline_label("embedding", "clustering"), "parameter": t.search_label(*[F.col(c) if c in rows.columns else F.lit(None) for c in ("k", "min_cluster_size")])})


def split_report(summary: dict | None) -> dict:
    """What the splits held, for the report; a missing summary gives an empty report."""
    s = summary or {}
    return {"cleaned_row_count": s.get("cleaned_row_count"), "cleaned_category_count": s.get("cleaned_category_count"), "subset_summaries": s.get("subset_summaries", {})}


def profile_summary(p, splits: dict) -> dict:
    """A profile's settings as one document."""
    subsets = p.subsets()
    return {
        "profile_name": p.name, "subset_configs": {k: {"size": s.size, "min_category_count": s.min_category_count, "min_subset_per_category": s.min_per_category, "use_full_dataset": s.size is None} for k, s in subsets.items()},
        "full_corpus_subsets": sorted(k for k, s in subsets.items() if s.size is None), "enabled_components": {"tfidf": p.tfidf, "dense": p.dense, "clustering": p.clustering, "retrieval": p.retrieval},
        "evaluation_sampling": {"silhouette_eval_sample_size": p.silhouette_sample, "npmi_sample_size": p.npmi_sample}, "split_fractions": {"train": p.train_fraction, "val": p.val_fraction, "test": p.test_fraction}, "split_summary": splits,
    }


def findings(summary: dict, metrics: list[dict], status: list[dict], retrieval: list[dict]) -> list[str]:
    """Sentences on the results: what was sampled, who leads each metric, what is missing, where retrieval is best."""
    out = []
    if full := summary.get("full_corpus_subsets"):
        out.append(f"On the whole corpus: {', '.join(full)}.")
    if s := summary.get("evaluation_sampling"):
        out.append(f"Silhouette was measured on at most {s['silhouette_eval_sample_size']:,} documents, coherence on {s['npmi_sample_size']:,}.")
    for name, what in (("nmi", "agreement with the categories"), ("npmi", "coherence of topics"), ("silhouette", "separation")):
        if known := [m for m in metrics if m.get(name) is not None]:
            best = max(known, key=lambda m: m[name])
            out.append(f"Best {what}: {best['pipeline']} ({name} {best[name]:.4f}).")
            if name == "nmi" and best.get("cluster_to_category_ratio") is not None:
                out.append(f"It has {best['cluster_to_category_ratio']:.2f} clusters a category.")
    if missing := [x["pipeline_name"] for x in status if x["enabled"] and not x["success"]]:
        out.append(f"Enabled, but without a result: {', '.join(missing)}.")
    if retrieval:
        best = max(retrieval, key=lambda r: (r["hit_rate"], r["mrr"]))
        out.append(f"Retrieval is best at {best['k']}: hit rate {best['hit_rate']:.4f}, mean reciprocal rank {best['mrr']:.4f}.")
    return out or ["No results."]


def risk_register(categories: DataFrame, records: DataFrame, duplicates: DataFrame) -> DataFrame:
    """risk, evidence (a share or a count) of a corpus. categories: category, n; records: n_labels, year, words; duplicates: duplicate_records."""
    total = categories.agg(F.sum("n").alias("t"))
    top = categories.orderBy(F.desc("n"), "category").limit(50).agg(F.sum("n").alias("h")).join(total, F.lit(True)).select(F.lit("top 50 categories, per cent").alias("risk"), (100.0 * F.col("h") / F.col("t")).alias("evidence"))
    rare = categories.agg(F.count_if(F.col("n") <= 50).cast("double").alias("evidence")).select(F.lit("categories of 50 records or fewer").alias("risk"), "evidence")
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    seen = records.agg(share(F.col("n_labels") > 1).alias("several labels, per cent"), F.count_if(F.col("words") <= 10).cast("double").alias("texts of 10 words or fewer"), share(F.col("year") >= 2018).alias("since 2018, per cent"), F.count("*").cast("double").alias("records"))
    return union_all([top, rare, seen.unpivot([], seen.columns, "risk", "evidence"), duplicates.select(F.lit("duplicate records").alias("risk"), F.col("duplicate_records").cast("double").alias("evidence"))])


def notebook(cells: list[tuple[str, str]]) -> dict:
    """A notebook document (format 4) of (kind, source) cells, kind markdown or code."""
    made = [{"cell_type": kind, "id": f"cell-{k}", "metadata": {}, "source": source.splitlines(keepends=True)} | ({"execution_count": None, "outputs": []} if kind == "code" else {}) for k, (kind, source) in enumerate(cells)]
    return {"nbformat": 4, "nbformat_minor": 5, "metadata": {"language_info": {"name": "python"}}, "cells": made}
