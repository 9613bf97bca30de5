"""The modelling pipeline: steps that may fail on their own, remembered by key, with a status at the end.

    python -m quarry.plans.runner --profile local --data DIR --out DIR

Three embeddings times three clusterings, and retrieval. TF-IDF with singular vectors is built in; dense encoders are
given as loaders (operators.encoders); a bundle whose encoder is missing fails, is named in the status, and stops no other.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import clean, cluster, encoders, metrics, papers, report, splits, tokens, vectors
from quarry.plans.profiles import Profile, profile
from quarry.sources import records

EMBEDDINGS, CLUSTERINGS = ("tfidf", "mpnet", "bert"), ("kmeans", "density", "ward")


@dataclass
class Steps:
    """Results and failures by key: a step runs once, and a failed one is not tried again."""

    done: dict[str, object] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def run(self, key: str, step: Callable[[], object], needs: tuple[str, ...] = ()) -> object | None:
        if key in self.done:
            return self.done[key]
        if key in self.failed:
            return None
        if missing := [n for n in needs if n not in self.done]:
            self.failed[key] = f"needs {', '.join(missing)}"
            return None
        began = time.perf_counter()
        try:
            self.done[key] = step()
        except Exception as e:  # a step's failure is its result; dependents are skipped
            self.failed[key] = f"{type(e).__name__}: {e}".splitlines()[0]
        self.seconds[key] = time.perf_counter() - began
        return self.done.get(key)


def sparse_vectors(rows: DataFrame, p: Profile) -> DataFrame:
    """id, embedding: singular vectors of TF-IDF, the vocabulary and weights from the train split."""
    rows = rows.withColumn("text", F.col("text_input"))
    weights = tokens.tfidf(rows, rows.where("split = 'train'"), p.min_df, p.max_features)
    numbered = weights.select("term").distinct().rdd.map(lambda r: r[0]).zipWithIndex().toDF(["term", "column"])  # at most max_features rows
    long = weights.join(numbered, "term").select(F.col("id").cast("long").alias("id"), "column", "weight")
    return vectors.singular_vectors(long, p.svd_components).withColumn("id", F.col("id").cast("string"))


def clustered(v: DataFrame, how: str, p: Profile) -> tuple[DataFrame, DataFrame]:
    """Search rows, and id, cluster of all rows of v (id, embedding, split); fitted on train, chosen on val."""
    train, val = (v.where(F.col("split") == s).select("id", "embedding") for s in ("train", "val"))
    every = v.select("id", "embedding")
    if how == "kmeans":
        grid = cluster.kmeans_grid(train, list(p.k_grid), p.silhouette_sample, val)
        best = grid.where("best").first()["k"]
        return grid, cluster.assign(every, cluster.fit_kmeans(train, best, threshold=p.mini_batch_rows)).select("id", "cluster")
    settings, rows = (list(p.min_cluster_sizes), p.density_rows) if how == "density" else (cluster.valid_ks(list(p.k_grid), min(train.count(), p.ward_rows)), p.ward_rows)
    grid = cluster.fit_grid(train, how, settings, p.silhouette_sample, val, rows)
    fitted = cluster.fit_sample(train, how, grid.where("best").first()["setting"], rows)
    return grid, cluster.label_all(every, fitted) if how == "density" else cluster.extend(every, fitted).select("id", "cluster")


def measured(labels: DataFrame, v: DataFrame, rows: DataFrame, p: Profile, **names: str) -> DataFrame:
    """One row of the metrics table for labels (id, cluster)."""
    j = labels.join(v.select("id", "embedding", "split"), "id").join(rows.select("id", "primary_category", "text_input"), "id").persist()
    dim, one = vectors.dimension(v), {}
    for s, prefix in (("val", "validation_"), ("test", "")):
        part = j.where(F.col("split") == s)
        one[f"{prefix}silhouette"] = metrics.silhouette(part.select("id", F.col("cluster").alias("label"), "embedding"), dim, p.silhouette_sample).first()["silhouette"]
        one[f"{prefix}nmi"] = metrics.nmi(part, "cluster", "primary_category").first()["nmi"]
    test = j.where("split = 'test'")
    size = test.count()
    drawn = report.sampled(test.select("id"), test.select("id", F.col("cluster").alias("label"), F.col("text_input").alias("text")), p.npmi_sample).where("label >= 0")
    one["npmi"] = metrics.coherence(drawn).agg(F.avg("npmi")).first()[0]
    found = labels.sparkSession.createDataFrame([(*names.values(), size, *one.values())], ", ".join([*(f"{k} string" for k in names), "subset_size long", *(f"{k} double" for k in one)]))
    counts = report.label_counts(j.withColumns({k: F.lit(x) for k, x in names.items()}), list(names))
    return report.metrics_rows(found, counts, list(names), p.npmi_sample)


def run(spark: SparkSession, p: Profile, data: str, out: str, models: dict[str, Callable] | None = None) -> Steps:
    """Clean, split, embed, cluster, measure, retrieve over data's documents; artifacts under out, by the profile's key. models: loaders of mpnet and bert."""
    steps, root, models = Steps(), f"{out}/{p.key()}", models or {}
    keep = lambda df, *key: records.cached(spark, lambda: df, root, *key)
    corpus = steps.run("clean", lambda: keep(clean.cleaned(papers.papers(spark, data)), "clean"))
    steps.run("manifest", lambda: clean.manifest(papers.papers(spark, data)).collect(), ("clean",))
    summaries = {}
    for s in p.subsets().values():

        def split(s=s):
            rows = corpus.withColumn("category", F.col("primary_category"))
            if s.size is not None:
                rows = splits.stratified_sample(rows, s.size, s.min_category_count, s.min_per_category, seed=p.seed)
            made = keep(splits.stratified_split(rows, seed=p.seed, train=p.train_fraction, val=p.val_fraction), s.name)
            summaries[s.name] = {"actual_size": made.count(), "category_count": made.select("category").distinct().count()}
            return made

        steps.run(f"split {s.name}", split, ("clean",))
    stages: list[dict] = []
    for e in EMBEDDINGS:
        stem, used = ("sparse", p.tfidf) if e == "tfidf" else ("dense", p.dense)
        name = next((n for n in p.subsets() if n.startswith(stem)), None)
        if not (used and name):
            continue

        def features(e=e, name=name):
            rows = steps.done[f"split {name}"]
            if e != "tfidf" and e not in models:
                raise KeyError(f"no encoder is given for {e}")
            made = sparse_vectors(rows, p) if e == "tfidf" else encoders.encode(rows.withColumn("text", F.col("text_input")), models[e], unit=e != "bert")
            v = keep(made.join(rows.select("id", "split", "primary_category"), "id"), name, e)
            n = {r["split"]: r["count"] for r in v.groupBy("split").count().collect()}
            stages.append({"stage_type": "embedding", "stage_name": e, "subset_name": name, "n_train": n.get("train", 0), "n_val": n.get("val", 0), "n_test": n.get("test", 0), "n_features": vectors.dimension(v), "device": encoders.device()})
            return v

        steps.run(f"embed {e}", features, (f"split {name}",))
        for c in CLUSTERINGS if p.clustering else ():

            def bundle(e=e, c=c, name=name):
                v = steps.done[f"embed {e}"]
                grid, labels = clustered(v, c, p)
                records.write_csv(grid, f"{root}/search/{e}_{c}/{name}")
                labels = keep(labels, name, f"{e}-{c}")
                stages.append({"stage_type": "clustering", "stage_name": f"{e}_{c}", "subset_name": name})
                return keep(measured(labels, v, steps.done[f"split {name}"], p, embedding=e, clustering=c, subset_name=name), name, f"{e}-{c}-metrics")

            steps.run(f"cluster {e} {c}", bundle, (f"embed {e}",))
    source = next((e for e in ("mpnet", "tfidf") if f"embed {e}" in steps.done), None)
    if p.retrieval:

        def retrieve():
            v = steps.done[f"embed {source}"]
            train, dim = v.where("split = 'train'"), vectors.dimension(v)
            queries = vectors.centroids(train, "primary_category", dim=dim).select("primary_category", F.col("centroid").alias("vector"))
            hits = vectors.top_k(queries, train.select("id", F.col("primary_category").alias("found"), "embedding"), 20, dim, "primary_category", "id")
            support = v.where("split = 'test'").groupBy("primary_category").agg(F.count("*").alias("weight"))
            stages.append({"stage_type": "retrieval", "stage_name": f"{source}_retrieval", "subset_name": "", "backend": vectors.backend()})
            return keep(vectors.retrieval_metrics(hits, support, queries.count(), "primary_category"), "retrieval")

        steps.run("retrieval", retrieve, (f"embed {source or 'mpnet'}",))
    steps.run("report", lambda: _report(spark, p, steps, stages, summaries, root))
    return steps


def _report(spark: SparkSession, p: Profile, steps: Steps, stages: list[dict], summaries: dict, root: str) -> dict:
    """Metrics table, status, summaries and findings, as one JSON document where root is a local path."""
    rows = [steps.done[k] for k in steps.done if k.startswith("cluster ")]
    table = []
    if rows:
        subsets = spark.createDataFrame([(k, v["category_count"]) for k, v in summaries.items()], "subset_name string, category_count long")
        table = [r.asDict() for r in report.sorted_metrics(report.with_category_ratio(report.union_all(rows), subsets)).collect()]  # nine rows at most
    for r in table:
        r["pipeline"] = f"{r['embedding'].upper()} + {r['clustering'].capitalize()}"
    status = [{"pipeline_name": k, "enabled": True, "success": k in steps.done, "reason": steps.failed.get(k, "")} for k in [*steps.done, *steps.failed]]
    retrieval = [r.asDict() for r in steps.done["retrieval"].collect()] if "retrieval" in steps.done else []
    for s in stages:
        key = {"embedding": f"embed {s['stage_name']}", "clustering": f"cluster {s['stage_name'].replace('_', ' ', 1)}"}.get(s["stage_type"], "retrieval")
        s["runtime_seconds"] = steps.seconds.get(key)
    summary = report.profile_summary(p, report.split_report({"subset_summaries": summaries}))
    made = {"profile": summary, "metrics": table, "status": status, "stages": stages, "retrieval": retrieval, "findings": report.findings(summary, table, status, retrieval)}
    if "://" not in root:
        records.write_json_document(f"{root}/report.json", made)
        records.write_json_document(f"{root}/report.ipynb", report.notebook([("markdown", "\n".join(f"- {x}" for x in made["findings"])), ("code", "import json\nreport = json.load(open('report.json'))\n")]))
        records.write_json_document(f"{root}/status.json", {"done": sorted(steps.done), "failed": steps.failed, "seconds": steps.seconds})
    return made


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--profile", default="local")
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--seed", type=int)
    given = a.parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    steps = run(spark, profile(given.profile, seed=given.seed), given.data, given.out)
    for key, why in steps.failed.items():
        print(f"{key}: {why}")
    return 1 if "clean" in steps.failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
