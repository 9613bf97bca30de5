"""Queries of sources that are written and read back, of metric rows, configurations, stage records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import clean, metrics, report, splits, vectors
from quarry.operators.papers import PAPERS_SQL, papers, table
from quarry.plans import text_queries as q
from quarry.plans.model_queries import DIM, VECTORS, split_vectors
from quarry.plans.registry import query
from quarry.plans.split_queries import rows, split_sql
from quarry.sources import records
from quarry.sources.shared import scratch


@query("a2_skip_blank", "SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def skip_blank(spark, d):
    """Events as JSON lines with a blank line after each, written and read strictly."""
    path = scratch(spark, "lines")
    table(spark, d, "events").select(F.concat("props", F.lit("\n   ")).alias("value")).write.text(path)
    return records.read_json_strict(spark, path, "k long").groupBy("k").agg(F.count("*").alias("n"))


@query("a10_routed_write", f"WITH {split_sql()} SELECT split, category, count(*) AS n FROM split_rows GROUP BY 1, 2")
def routed(spark, d):
    """Splits written to a folder each, and read back."""
    path = scratch(spark, "routed")
    records.write_parquet(splits.stratified_split(rows(spark, d)), path, ["split"])
    return spark.read.parquet(path).groupBy("split", "category").agg(F.count("*").alias("n"))


@query("a11_csv", "SELECT n_nationkey, n_name FROM nation")
def csv(spark, d):
    path = scratch(spark, "csv")
    records.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return records.read_csv(spark, path, "n_nationkey int, n_name string")


@query("a14_arrays", "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def arrays(spark, d):
    """Vectors written as float arrays, and read back in their order."""
    path = scratch(spark, "arrays")
    records.write_parquet(table(spark, d, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("c9_supported_clusters", "SELECT label, count(*) AS m FROM embeddings WHERE label >= 3 GROUP BY 1 HAVING count(*) >= 50")
def supported_clusters(spark, d):
    labels = table(spark, d, "embeddings").select(F.when(F.col("label") < 3, -1).otherwise(F.col("label")).alias("label"))
    return metrics.supported(labels, 50)


@query("k4_best_config", """WITH s AS (SELECT p_brand AS stage, p_size AS setting, p_retailprice AS score FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT p_brand AS stage, p_size AS setting, p_retailprice AS score FROM part WHERE p_partkey % 2 = 1),
b AS (SELECT stage, setting, max(score) AS score FROM f GROUP BY 1, 2 UNION ALL SELECT stage, setting, max(score) FROM s WHERE (stage, setting) NOT IN (SELECT (stage, setting) FROM f) GROUP BY 1, 2)
SELECT stage, setting, score FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, setting) AS r FROM b) WHERE r = 1""")
def best_config(spark, d):
    part = table(spark, d, "part")
    rows_of = lambda k: part.where(F.col("p_partkey") % 2 == k).select(F.col("p_brand").alias("stage"), F.col("p_size").alias("setting"), F.col("p_retailprice").alias("score"))
    return report.best_configs(rows_of(0), rows_of(1), ["stage"], "score", "setting").select("stage", "setting", "score")


SAMPLED_SQL = f"sampled AS (SELECT * FROM ({VECTORS.replace(', CAST(embedding AS DOUBLE[]) AS e', '')}) ORDER BY sha1('42' || id), id LIMIT 150)"


@query("m4_sampled_texts", f"WITH {SAMPLED_SQL} SELECT s.id, s.label, length(d.text) AS n FROM sampled s JOIN documents d ON s.id = CAST(d.doc_id AS VARCHAR)")
def sampled_texts(spark, d):
    """Texts of a sample of rows, with their labels."""
    labelled = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.char_length("text").cast("long").alias("n"))
    return report.sampled(labelled, texts, 150).select("id", "label", "n")


SV_SQL = f"""{split_sql("label", "42", "sv", VECTORS)}, parts AS (SELECT label, i, avg(e[i]) AS m FROM sv, range(1, {DIM + 1}) AS t(i) GROUP BY 1, 2), centers AS (SELECT label, list(m ORDER BY i) AS c FROM parts GROUP BY 1),
near AS (SELECT v.id, v.split, v.label AS own, c.label AS cluster, list_distance(v.e, c.c) AS dist FROM sv v, centers c), ass AS (SELECT id, split, own, arg_min(cluster, dist) AS cluster FROM near GROUP BY 1, 2, 3)"""


def split_clusters(spark, d):
    """id, own, cluster, split of the vectors, and subset_name."""
    s = split_vectors(spark, d)
    centers = vectors.centroids(s, "label", dim=DIM).select(F.col("label").alias("cluster"), "centroid")
    return vectors.nearest(s.withColumnRenamed("label", "own"), centers, "cluster", DIM).withColumn("subset_name", F.lit("all"))


@query("m5_metrics_row", f"""WITH {SV_SQL} SELECT 'all' AS subset_name, count(*) FILTER (WHERE split = 'test') AS subset_size, round(avg(CASE WHEN split = 'test' AND own = cluster THEN 1.0 WHEN split = 'test' THEN 0.0 END), 6) AS purity,
count(DISTINCT cluster) FILTER (WHERE split = 'val') AS validation_label_count, count(DISTINCT cluster) FILTER (WHERE split = 'test') AS test_label_count, true AS ran_successfully,
CASE WHEN count(*) FILTER (WHERE split = 'test') > 50 THEN 'npmi of 50 sampled test documents' ELSE '' END AS notes FROM ass""")
def metrics_row(spark, d):
    c = split_clusters(spark, d)
    measured = c.where("split = 'test'").groupBy("subset_name").agg(F.count("*").alias("subset_size"), F.round(F.avg((F.col("own") == F.col("cluster")).cast("int")), 6).alias("purity"))
    return report.metrics_rows(measured, report.label_counts(c, ["subset_name"]), ["subset_name"], 50)


@query("m6_cluster_ratio", f"WITH {SV_SQL} SELECT 'all' AS subset_name, round(count(DISTINCT cluster) FILTER (WHERE split = 'test') * 1.0 / count(DISTINCT own), 6) AS ratio FROM ass")
def ratio(spark, d):
    c = split_clusters(spark, d)
    subsets = c.groupBy("subset_name").agg(F.count_distinct("own").alias("category_count"))
    return report.with_category_ratio(report.label_counts(c, ["subset_name"]), subsets).select("subset_name", F.round("cluster_to_category_ratio", 6).alias("ratio"))


@query("o9_stage_runtimes", """SELECT CASE event_id % 3 WHEN 0 THEN 'embedding' WHEN 1 THEN 'clustering' ELSE 'retrieval' END AS stage_type, event_type AS stage_name, count(*) AS runs, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2""")
def runtimes(spark, d):
    """Metadata records of the three kinds of stages, in one table."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("stage_name"), F.concat(F.lit("subset_"), F.col("user_id") % 3).alias("subset_name"), F.col("value").alias("runtime_seconds"))
    kinds = [e.where(F.col("event_id") % 3 == k).drop("event_id") for k in range(3)]
    kinds[0] = kinds[0].withColumn("device", F.lit("cpu"))
    return report.stage_runtimes(*kinds).groupBy("stage_type", "stage_name").agg(F.count("*").alias("runs"), F.round(F.sum("runtime_seconds"), 4).alias("seconds"))


@query("o10_search_results", """SELECT 'tfidf' AS embedding, 'kmeans' AS clustering, 'main' AS subset_name, 'TFIDF + Kmeans' AS pipeline, 'k=' || p_size AS parameter, count(*) AS n FROM part GROUP BY 5
UNION ALL SELECT 'mpnet', 'hdbscan', 'main', 'MPNET + Hdbscan', 'k=' || p_size, count(*) FROM part WHERE p_size > 25 GROUP BY 5""")
def search_results(spark, d):
    """Two stages' search tables as CSV files, found by their paths."""
    root, part = scratch(spark, "search"), table(spark, d, "part").select(F.col("p_size").alias("k"), F.col("p_retailprice").alias("silhouette"))
    records.write_csv(part, f"{root}/tfidf_kmeans/main")
    records.write_csv(part.where("k > 25"), f"{root}/mpnet_hdbscan/main")
    found = report.search_results(spark, f"{root}/*/*/*.csv", "k int, silhouette double")
    return found.groupBy("embedding", "clustering", "subset_name", "pipeline", "parameter").agg(F.count("*").alias("n"))


@query("o12_risk_register", f"""WITH {PAPERS_SQL}, cats AS (SELECT split_part(categories, ' ', 2) AS category, count(*) AS n FROM papers GROUP BY 1), dup AS (SELECT {q.key()} AS k, count(*) AS n FROM papers GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT {q.words()} AS words, 2000 + line_no % 30 AS year, len(string_split(categories, ' ')) AS n_labels FROM papers)
SELECT 'top 50 categories, per cent' AS risk, round(100.0 * (SELECT sum(n) FROM (SELECT n FROM cats ORDER BY n DESC, category LIMIT 50)) / (SELECT sum(n) FROM cats), 6) AS evidence
UNION ALL SELECT 'categories of 50 records or fewer', CAST(count(*) FILTER (WHERE n <= 50) AS DOUBLE) FROM cats
UNION ALL SELECT 'several labels, per cent', round(100.0 * count(*) FILTER (WHERE n_labels > 1) / count(*), 6) FROM r UNION ALL SELECT 'texts of 10 words or fewer', CAST(count(*) FILTER (WHERE words <= 10) AS DOUBLE) FROM r
UNION ALL SELECT 'since 2018, per cent', round(100.0 * count(*) FILTER (WHERE year >= 2018) / count(*), 6) FROM r UNION ALL SELECT 'records', CAST(count(*) AS DOUBLE) FROM r
UNION ALL SELECT 'duplicate records', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) FROM dup""")
def risks(spark, d):
    p = papers(spark, d)
    categories = p.groupBy(F.split("categories", " ")[1].alias("category")).agg(F.count("*").alias("n"))
    seen = p.select(F.size(F.split("categories", " ")).alias("n_labels"), (2000 + F.col("line_no") % 30).alias("year"), t.word_count("abstract").alias("words"))
    return report.risk_register(categories, seen, clean.duplicate_summary(p, t.content_key("title", "abstract"))).select("risk", F.round("evidence", 6).alias("evidence"))
