"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.plans import catalog

HEADLINE = ["c5_drop_manifest", "c6_clean_records", "f2_all_category_counts", "f13_artifact_patterns", "f15_percentiles", "g2_vocabulary_metrics", "e4_stratified_split", "j1_tfidf", "h11_nearest_centroid", "m1_silhouette", "m3_npmi", "n5_mrr_hit", "h4_three_key_join", "h13_pair_cooccurrence"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("a7_row_count")
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
