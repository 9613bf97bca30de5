"""Queries of features, vectors, clusters, metrics, retrieval, joins and reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarry.functions import text as t
from quarry.operators import cluster, metrics, tokens, vectors
from quarry.operators.papers import DATED_SQL, PAPERS_SQL, dated, papers, table
from quarry.plans import text_queries as q
from quarry.plans.registry import query
from quarry.plans.split_queries import split_sql
from quarry.sources.shared import materialize

DIM = 64
#: Lines of orders whose pairs of suppliers one task makes.
PAIR_ROWS = 500_000
VECTORS = "SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
CENTROIDS_SQL = f"""vecs AS ({VECTORS}), parts AS (SELECT label, i, avg(e[i]) AS m FROM vecs, range(1, {DIM + 1}) AS t(i) GROUP BY 1, 2),
centers AS (SELECT label, list(m ORDER BY i) AS c FROM parts GROUP BY 1)"""


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")


TFIDF_SQL = f"""{PAPERS_SQL}, term_rows AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({q.sparse('text')}) AS term FROM papers) WHERE length(term) >= 2 GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM term_rows GROUP BY 1 HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 2000),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM papers)) / (1.0 + df)) + 1 AS idf FROM vocab),
w AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM term_rows JOIN idf USING (term))"""


@query("j1_tfidf", f"WITH {TFIDF_SQL} SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 5) AS weight FROM w")
def tfidf(spark, d):
    return tokens.tfidf(papers(spark, d), min_df=5, max_features=2000).select("id", "term", F.round("weight", 5).alias("weight"))


@query("j2_svd")
def svd(spark, d):
    """Rows-only: singular vectors are unique up to sign, so tests check their products instead."""
    weights = materialize(tokens.tfidf(papers(spark, d), min_df=5, max_features=500), "weights")  # read twice
    index = weights.select("term").distinct().withColumn("column", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("term")) - 1)
    return vectors.singular_vectors(weights.join(vectors.small(index), "term").select(F.col("id").cast("long").alias("id"), "column", "weight"), 16)


@query("l10_centroids", f"WITH {CENTROIDS_SQL} SELECT label, i AS dim, round(m, 6) AS value FROM parts")
def centers(spark, d):
    return vectors.centroids(vecs(spark, d), "label", dim=DIM).select("label", F.posexplode("centroid").alias("dim", "v")).select("label", (F.col("dim") + 1).cast("long").alias("dim"), F.round("v", 6).alias("value"))


NEAREST_SQL = f"""{CENTROIDS_SQL}, near AS (SELECT v.id, v.label AS own, c.label AS cluster, list_distance(v.e, c.c) AS dist FROM vecs v, centers c),
assigned AS (SELECT id, own, arg_min(cluster, dist) AS cluster, min(dist) AS distance FROM near GROUP BY 1, 2)"""


def assigned(spark, d):
    v = vecs(spark, d)
    c = vectors.centroids(v, "label", dim=DIM).select(F.col("label").alias("cluster"), "centroid")
    return vectors.nearest(v.withColumnRenamed("label", "own"), c, "cluster", DIM)


@query("h11_nearest_centroid", f"WITH {NEAREST_SQL} SELECT id, own, cluster, round(distance, 6) AS distance FROM assigned")
def nearest(spark, d):
    return assigned(spark, d).select("id", "own", "cluster", F.round("distance", 6).alias("distance"))


@query("l5_predict", f"WITH {NEAREST_SQL} SELECT cluster, count(*) AS n FROM assigned GROUP BY 1")
def predict(spark, d):
    return assigned(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))


@query("l7_noise_rate", "SELECT vec_id % 3 AS part, avg(CASE WHEN label < 3 THEN 1.0 ELSE 0.0 END) AS noise_rate FROM embeddings GROUP BY 1")
def noise(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("part"), F.when(F.col("label") < 3, -1).otherwise(F.col("label")).alias("cluster"))
    return cluster.noise_rate(e, ["part"])


@query("l8_noise_repair", f"""WITH vecs AS ({VECTORS}), parts AS (SELECT label, i, avg(e[i]) AS m FROM vecs, range(1, {DIM + 1}) AS t(i) WHERE label >= 3 GROUP BY 1, 2),
centers AS (SELECT label, list(m ORDER BY i) AS c FROM parts GROUP BY 1), near AS (SELECT v.id, v.label AS own, c.label, list_distance(v.e, c.c) AS dist FROM vecs v, centers c)
SELECT id, CASE WHEN own < 3 THEN arg_min(label, dist) ELSE own END AS cluster FROM near GROUP BY id, own""")
def repair(spark, d):
    v = vecs(spark, d)
    fitted = v.select("id", F.when(F.col("label") < 3, -1).otherwise(F.col("label")).alias("cluster"))
    near = cluster.extend(v.select("id", "embedding"), fitted).select("id", F.col("cluster").alias("near"))
    return fitted.join(near, "id").select("id", F.when(F.col("cluster") < 0, F.col("near")).otherwise(F.col("cluster")).alias("cluster"))


@query("k3_identity_bypass", "SELECT vec_id, label FROM embeddings")
def bypass(spark, d):
    from quarry.operators.encoders import reduce_vectors

    return reduce_vectors(table(spark, d, "embeddings"), "identity", 10).select("vec_id", "label")


@query("l1_kmeans_grid")
def kmeans_grid(spark, d):
    s = split_vectors(spark, d).select("id", "embedding", "split")
    return cluster.kmeans_grid(s.where("split = 'train'").drop("split"), [5, 10], validation=s.where("split = 'val'").drop("split"))


@query("l2_mini_batch")
def mini_batch(spark, d):
    """Rows-only: centers depend on the draws; tests hold their cost against that of full k-means."""
    v = vecs(spark, d).select("id", "embedding")
    return cluster.assign(v, cluster.fit_kmeans(v, 10, "mini_batch")).select("id", "cluster")


@query("l6_density_grid")
def density_grid(spark, d):
    return cluster.fit_grid(vecs(spark, d).select("id", "embedding"), "density", [3, 5, 10])


@query("l9_ward_grid")
def ward_grid(spark, d):
    return cluster.fit_grid(vecs(spark, d).select("id", "embedding"), "ward", [5, 10])


@query("l6_density")
def density(spark, d):
    v = vecs(spark, d).select("id", "embedding")
    return cluster.label_all(v, cluster.fit_sample(v, "density", 5))


@query("l9_ward")
def ward(spark, d):
    v = vecs(spark, d).select("id", "embedding")
    return cluster.extend(v, cluster.fit_sample(v, "ward", 10)).select("id", "cluster")


@query("m1_silhouette", f"""WITH s AS (SELECT * FROM ({VECTORS}) ORDER BY sha1('42' || id), id LIMIT 400), p AS (SELECT a.id, a.label, b.label AS l2, avg(list_distance(a.e, b.e)) AS dist FROM s a, s b WHERE a.id <> b.id GROUP BY 1, 2, 3),
x AS (SELECT id, min(CASE WHEN label = l2 THEN dist END) AS a, min(CASE WHEN label <> l2 THEN dist END) AS b FROM p GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, (SELECT count(*) FROM s) AS points FROM x""")
def silhouette(spark, d):
    return metrics.silhouette(vecs(spark, d), DIM, 400).select(F.round("silhouette", 6).alias("silhouette"), "points")


@query("m2_nmi", f"""WITH {NEAREST_SQL}, g AS (SELECT own, cluster, count(*) AS n FROM assigned GROUP BY 1, 2), tt AS (SELECT sum(n) AS tot FROM g),
m AS (SELECT sum(n / tot * ln(n * tot / (na * nb))) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY own) AS na, sum(n) OVER (PARTITION BY cluster) AS nb FROM g), tt),
ha AS (SELECT -sum(n / tot * ln(n / tot)) AS h FROM (SELECT own, sum(n) AS n FROM g GROUP BY 1), tt), hb AS (SELECT -sum(n / tot * ln(n / tot)) AS h FROM (SELECT cluster, sum(n) AS n FROM g GROUP BY 1), tt)
SELECT round(CASE WHEN ha.h = 0 AND hb.h = 0 THEN 1.0 WHEN mi <= 0 THEN 0.0 ELSE mi / ((ha.h + hb.h) / 2) END, 6) AS nmi FROM m, ha, hb""")
def nmi(spark, d):
    return metrics.nmi(assigned(spark, d), "own", "cluster").select(F.round("nmi", 6).alias("nmi"))


NPMI_SQL = f"""{PAPERS_SQL}, tk AS (SELECT id, split_part(categories, ' ', 2) AS label, unnest({q.sparse('text')}) AS term FROM papers), post AS (SELECT DISTINCT id, term FROM tk),
vocab AS (SELECT term, count(DISTINCT id) AS df FROM tk WHERE length(term) >= 2 GROUP BY 1 HAVING count(DISTINCT id) >= 2 ORDER BY count(*) DESC, term LIMIT 20000),
large AS (SELECT split_part(categories, ' ', 2) AS label FROM papers GROUP BY 1 HAVING count(*) >= 5),
best AS (SELECT * FROM (SELECT label, term, df, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) AS r FROM tk JOIN vocab USING (term) JOIN large USING (label) GROUP BY 1, 2, 3) WHERE r <= 10),
pairs AS (SELECT a.label, a.term AS t1, b.term AS t2, a.df AS d1, b.df AS d2 FROM best a JOIN best b ON a.label = b.label AND a.term < b.term),
co AS (SELECT t1, t2, count(*) AS co FROM (SELECT DISTINCT t1, t2 FROM pairs) JOIN post a ON a.term = t1 JOIN post b ON b.term = t2 AND a.id = b.id GROUP BY 1, 2), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM papers)"""


@query("m3_npmi", f"WITH {NPMI_SQL} SELECT label, round(avg(ln((co / n) / ((d1 / n) * (d2 / n))) / -ln(co / n)), 6) AS npmi FROM pairs JOIN co USING (t1, t2), nn WHERE co < n GROUP BY 1")
def npmi(spark, d):
    docs = papers(spark, d).select("id", F.split("categories", " ")[1].alias("label"), "text")
    return metrics.coherence(docs).select("label", F.round("npmi", 6).alias("npmi"))


SPLIT_VECTORS = split_sql("label", "42", "sv", VECTORS)
KNN_SQL = f"""{SPLIT_VECTORS}, parts AS (SELECT label, i, avg(e[i]) AS m FROM sv, range(1, {DIM + 1}) AS t(i) WHERE split = 'train' GROUP BY 1, 2), centers AS (SELECT label, list(m ORDER BY i) AS c FROM parts GROUP BY 1),
scored AS (SELECT c.label, v.id, v.label AS found, list_cosine_similarity(c.c, v.e) AS score FROM centers c, sv v WHERE v.split = 'train'),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 20),
support AS (SELECT label, count(*) AS weight FROM sv WHERE split = 'test' GROUP BY 1)"""


def split_vectors(spark, d):
    from quarry.operators.splits import stratified_split

    return materialize(stratified_split(vecs(spark, d), "label"), "split")  # read several times


def hits(spark, d):
    s = split_vectors(spark, d)
    train = s.where("split = 'train'")
    queries = vectors.centroids(train, "label", dim=DIM).select("label", F.col("centroid").alias("vector"))
    return vectors.top_k(queries, train.select("id", F.col("label").alias("found"), "embedding"), 20, DIM, "label", "id"), s


@query("n1_knn", f"WITH {KNN_SQL} SELECT label, rank, id, found, round(score, 6) AS score FROM hits")
def knn(spark, d):
    return hits(spark, d)[0].select("label", F.col("rank").cast("long").alias("rank"), "id", "found", F.round("score", 6).alias("score"))


@query("n5_mrr_hit", f"""WITH {KNN_SQL}, f AS (SELECT label, min(CASE WHEN found = label THEN rank END) AS first FROM hits GROUP BY 1)
SELECT k, round(sum(CASE WHEN first <= k THEN CAST(weight AS DOUBLE) / first ELSE 0 END) / sum(weight), 6) AS mrr, round(sum(CASE WHEN first <= k THEN weight ELSE 0 END) * 1.0 / sum(weight), 6) AS hit_rate,
(SELECT count(*) FROM centers) AS query_classes, CAST(sum(weight) AS BIGINT) AS weighted_docs FROM f JOIN support USING (label), (VALUES (5), (10), (20)) AS t(k) GROUP BY 1""")
def mrr(spark, d):
    found, s = hits(spark, d)
    support = s.where("split = 'test'").groupBy("label").agg(F.count("*").alias("weight"))
    n = s.where("split = 'train'").select("label").distinct().count()
    return vectors.retrieval_metrics(found, support, n).select("k", F.round("mrr", 6).alias("mrr"), F.round("hit_rate", 6).alias("hit_rate"), "query_classes", "weighted_docs")


@query("n6_examples", f"WITH {KNN_SQL} SELECT label, weight AS test_support, list_aggregate(list(id ORDER BY rank), 'string_agg', ',') AS ids FROM hits JOIN support USING (label) WHERE rank <= 10 GROUP BY 1, 2 ORDER BY label LIMIT 10")
def examples(spark, d):
    found, s = hits(spark, d)
    support = s.where("split = 'test'").groupBy("label").agg(F.count("*").alias("test_support"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return found.where("rank <= 10").groupBy("label").agg(F.array_join(ordered, ",").alias("ids")).join(support, "label").select("label", "test_support", "ids").orderBy("label").limit(10)


@query("n2_inner_product", f"WITH {KNN_SQL} SELECT label, arg_max(id, (round(score, 9), -rank)) AS best FROM hits GROUP BY 1")
def inner_product(spark, d):
    return hits(spark, d)[0].where("rank = 1").select("label", F.col("id").alias("best"))


# joins and reports over the star schema

@query("h1_left_join", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def left_join(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("h3_fill_missing", "SELECT p.p_size, p.n AS parts, coalesce(l.n, 0) AS lines FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) p LEFT JOIN (SELECT p_size, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49 GROUP BY 1) l ON p.p_size = l.p_size")
def fill_missing(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 49")
    sold = p.join(l, p.p_partkey == l.l_partkey).groupBy("p_size").agg(F.count("*").alias("lines"))
    return p.groupBy("p_size").agg(F.count("*").alias("parts")).join(sold, "p_size", "left").select("p_size", "parts", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("h4_three_key_join", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, x.total FROM lineitem l JOIN (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2, 3) x ON l.l_orderkey = x.l_orderkey AND l.l_partkey = x.l_partkey AND l.l_suppkey = x.l_suppkey")
def three_keys(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return l.join(l.groupBy(*keys).agg(F.sum("l_quantity").alias("total")), keys).select("l_orderkey", "l_linenumber", "l_partkey", "total")


@query("h5_map_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_lookup(spark, d):
    c, n = table(spark, d, "customer"), vectors.small(table(spark, d, "nation"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("h6_hash_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def hash_lookup(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("h7_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 100000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("h9_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("h10_common_keys", "SELECT label, n FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1) WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 2 = 1)")
def common_keys(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.where("vec_id % 2 = 0").groupBy("label").agg(F.count("*").alias("n")).join(e.where("vec_id % 2 = 1").select("label").distinct(), "label")


@query("h13_pair_cooccurrence", "SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def cooccurrence(spark, d):
    """Orders are dealt to so many tasks that one makes the pairs of about PAIR_ROWS lines: pairs are several times their lines, so sizes of shuffled lines would say too little of the table of pairs that a task counts. Suppliers of an order are paired one after the other."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").where("l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL")
    orders = lines.repartition(1 + lines.count() // PAIR_ROWS, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("x"))
    first = orders.where(F.size("x") > 1).select("x", F.posexplode("x").alias("i", "s1")).where("i + 1 < size(x)")
    return first.select("s1", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("s2")).groupBy("s1", "s2").agg(F.count("*").alias("n"))


@query("h14_row_alignment", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def alignment(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


REVENUE_SQL = "rev AS (SELECT p_type, p_brand, round(sum(l_quantity), 2) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def revenue(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("r"))


@query("i8_winner_margin", f"WITH {REVENUE_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY r DESC, p_brand) AS k, lead(r) OVER (PARTITION BY p_type ORDER BY r DESC, p_brand) AS next FROM rev) SELECT p_type, p_brand AS winner, round(r - next, 2) AS margin FROM x WHERE k = 1")
def margin(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.desc("r"), "p_brand")
    return revenue(spark, d).withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("r").over(w)).where("k = 1").select("p_type", F.col("p_brand").alias("winner"), F.round(F.col("r") - F.col("next"), 2).alias("margin"))


@query("i9_metric_leaders", "SELECT 'quantity' AS metric, arg_max(l_orderkey, (l_quantity, -l_orderkey)) AS leader FROM lineitem UNION ALL SELECT 'price', arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) FROM lineitem")
def leaders(spark, d):
    l = table(spark, d, "lineitem")
    best = lambda c: F.max_by("l_orderkey", F.struct(c, -F.col("l_orderkey")))
    return l.agg(best("l_quantity").alias("quantity"), best("l_extendedprice").alias("price")).unpivot([], ["quantity", "price"], "metric", "leader")


@query("i10_gaps", f"WITH {REVENUE_SQL} SELECT p_type, round(max(r) - min(r), 2) AS gap FROM rev GROUP BY 1 ORDER BY abs(max(r) - min(r)) DESC, p_type")
def gaps(spark, d):
    return revenue(spark, d).groupBy("p_type").agg(F.round(F.max("r") - F.min("r"), 2).alias("gap")).orderBy(F.abs("gap").desc(), "p_type")


@query("i11_best_of_grid", f"WITH {REVENUE_SQL} SELECT p_type, arg_max(p_brand, (r, -CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER))) AS best FROM rev GROUP BY 1")
def best_of_grid(spark, d):
    return revenue(spark, d).groupBy("p_type").agg(F.max_by("p_brand", F.struct("r", -F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"))).alias("best"))


EXPECTED = "(VALUES ('TFIDF', 'kmeans', true), ('MPNET', 'kmeans', true), ('BERT', 'ward', false)) AS e(embedding, clustering, enabled)"
RUNS = "(VALUES ('TFIDF', 'kmeans', true), ('MPNET', 'kmeans', false)) AS r(embedding, clustering, ok)"


@query("h8_pipeline_status", f"SELECT e.embedding, e.clustering, enabled, r.ok IS NOT NULL AS ran, coalesce(r.ok, false) AS success, CASE WHEN NOT enabled THEN 'disabled by default' WHEN r.ok IS NULL THEN 'not run' WHEN NOT r.ok THEN 'failed' ELSE '' END AS reason_skipped FROM {EXPECTED} LEFT JOIN {RUNS} ON e.embedding = r.embedding AND e.clustering = r.clustering")
def status(spark, d):
    from quarry.operators.report import pipeline_status

    expected = spark.createDataFrame([("TFIDF", "kmeans", True), ("MPNET", "kmeans", True), ("BERT", "ward", False)], "embedding string, clustering string, enabled boolean")
    runs = spark.createDataFrame([("TFIDF", "kmeans", True), ("MPNET", "kmeans", False)], "embedding string, clustering string, ok boolean")
    return pipeline_status(expected, runs, ["embedding", "clustering"])


@query("o6_report_table", f"WITH {DATED_SQL} SELECT upper(domain) || ' + ' || upper(left(category, 1)) || lower(substr(category, 2)) AS pipeline, count(*) AS n, round(avg(n_authors), 6) AS mean_authors FROM dated GROUP BY 1 ORDER BY n DESC, pipeline")
def report_table(spark, d):
    return dated(spark, d).groupBy(t.pipeline_label("domain", "category").alias("pipeline")).agg(F.count("*").alias("n"), F.round(F.avg("n_authors"), 6).alias("mean_authors")).orderBy(F.desc("n"), "pipeline")
