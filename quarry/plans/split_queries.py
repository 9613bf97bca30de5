"""Queries of sampling, splitting and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import splits
from quarry.operators.papers import table
from quarry.plans.registry import query

ROWS = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS category FROM documents"
COUNTS_SQL = "counts AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY 1)"


def rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("category"))


def split_sql(group: str = "category", seed: str = "42", name: str = "split_rows", source: str = ROWS) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (r, s, n_train, n_val), CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM (
SELECT * REPLACE (CASE WHEN s - n_train - n_val < 1 AND n_train > 1 THEN n_train - 1 ELSE n_train END AS n_train) FROM (
SELECT *, greatest(1, round_even(s * 0.7, 0)) AS n_train, greatest(1, round_even(s * 0.1, 0)) AS n_val FROM (
SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY sha1('{seed}' || id), id) AS r, count(*) OVER (PARTITION BY {group}) AS s FROM ({source})))))"""


@query("e1_category_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def counts(spark, d):
    return rows(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def quota_sql(target: int, min_count: int, minimum: int) -> str:
    return f"""{COUNTS_SQL}, e AS (SELECT *, count(*) OVER () AS k FROM counts WHERE n >= {min_count}),
b AS (SELECT *, least(CASE WHEN {target} < {minimum} * k THEN greatest(1, {target} // k) ELSE {minimum} END, n) AS base FROM e),
c AS (SELECT *, n - base AS cap, {target} - sum(base) OVER () AS remaining, sum(n - base) OVER () AS total FROM b),
x AS (SELECT *, CASE WHEN remaining > 0 AND total > 0 THEN CAST(remaining AS DOUBLE) * cap / total ELSE 0 END AS share FROM c),
f AS (SELECT *, least(cap, floor(share)) AS fl FROM x),
g AS (SELECT *, CASE WHEN share > 0 THEN {target} - sum(base + fl) OVER () ELSE 0 END AS rest, base + fl < n AS roomy FROM f),
quotas AS (SELECT category, n, CAST(base + fl + CASE WHEN roomy AND row_number() OVER (PARTITION BY roomy ORDER BY share - floor(share) DESC, cap DESC, category DESC) <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g)"""


@query("e2_quotas", f"WITH {quota_sql(137, 5, 3)} SELECT * FROM quotas")
def quotas(spark, d):
    return splits.quotas(counts(spark, d), 137, 5, 3)


@query("e3_stratified_sample", f"WITH {quota_sql(137, 5, 3)}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha1('42' || id), id) AS rank FROM ({ROWS})) SELECT id, r.category FROM r JOIN quotas ON r.category = quotas.category WHERE rank <= quota")
def sample(spark, d):
    return splits.stratified_sample(rows(spark, d), 137, 5, 3)


@query("e4_stratified_split", f"WITH {split_sql()} SELECT id, category, split FROM split_rows")
def split(spark, d):
    return splits.stratified_split(rows(spark, d))


@query("e5_full_corpus_split", f"WITH {split_sql('category', '7', 'split_rows', 'SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category FROM documents')} SELECT id, category, split FROM split_rows")
def full_split(spark, d):
    return splits.stratified_split(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category")), seed=7)


@query("e6_split_lookup", f"WITH {split_sql()} SELECT doc_id, n_chars, split FROM documents JOIN split_rows ON id = CAST(doc_id AS VARCHAR)")
def lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(splits.stratified_split(rows(spark, d)), F.col("doc_id").cast("string") == F.col("id")).select("doc_id", "n_chars", "split")


@query("e7_split_summary", f"WITH {split_sql()} SELECT split, count(*) AS n, count(DISTINCT category) AS categories FROM split_rows GROUP BY 1")
def split_summary(spark, d):
    return splits.stratified_split(rows(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))


@query("e9_uniform_sample", f"SELECT id, category FROM ({ROWS}) ORDER BY sha1('42' || id), id LIMIT 100")
def uniform(spark, d):
    return rows(spark, d).orderBy(splits.draw(42), "id").limit(100)


@query("e10_feasibility", f"WITH {COUNTS_SQL}, c2 AS (SELECT k, n FROM counts, (VALUES (2), (3), (5), (10), (20)) AS t(k) WHERE n >= k) SELECT k AS threshold, CAST(sum(n) AS BIGINT) AS eligible_rows, count(*) AS eligible_categories, min(n) >= 4 AND min(n - round_even(n * 0.7, 0)) >= 2 AS feasible FROM c2 GROUP BY 1")
def feasibility(spark, d):
    c = counts(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 10, 20)]))).where("n >= threshold")
    held = F.min(F.col("n") - F.bround(F.col("n") * 0.7))
    return c.groupBy("threshold").agg(F.sum("n").alias("eligible_rows"), F.count("*").alias("eligible_categories"), ((F.min("n") >= 4) & (held >= 2)).alias("feasible"))


RANDOM_SQL = split_sql("one", "42", "random_rows", f"SELECT *, 1 AS one FROM ({ROWS})")
DRIFT = """SELECT s.split, a.category, round(100.0 * coalesce(n, 0) / ns, 6) AS split_pct, round(100.0 * na / total, 6) AS global_pct, round(abs(100.0 * coalesce(n, 0) / ns - 100.0 * na / total), 6) AS diff_pct
FROM (SELECT category, count(*) AS na, sum(count(*)) OVER () AS total FROM {t} GROUP BY 1) a CROSS JOIN (SELECT split, count(*) AS ns FROM {t} GROUP BY 1) s
LEFT JOIN (SELECT split, category, count(*) AS n FROM {t} GROUP BY 1, 2) b ON a.category = b.category AND s.split = b.split"""


def _rounded(df):
    return df.select("split", "category", *[F.round(c, 6).alias(c) for c in ("split_pct", "global_pct", "diff_pct")])


@query("e11_random_split", f"WITH {RANDOM_SQL} SELECT id, category, split FROM random_rows")
def random_split(spark, d):
    return splits.random_split(rows(spark, d))


@query("e12_drift", f"WITH {split_sql()} {DRIFT.format(t='split_rows')}")
def drift(spark, d):
    return _rounded(splits.drift(splits.stratified_split(rows(spark, d))))


@query("e13_worst_drift", f"WITH {RANDOM_SQL} SELECT * FROM ({DRIFT.format(t='random_rows')}) WHERE split = 'test' ORDER BY diff_pct DESC, category LIMIT 10")
def worst(spark, d):
    return _rounded(splits.drift(splits.random_split(rows(spark, d)))).where("split = 'test'").orderBy(F.desc("diff_pct"), "category").limit(10)
