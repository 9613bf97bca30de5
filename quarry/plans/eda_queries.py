"""Queries of the exploratory tables: frequencies, percentiles, artifacts, tokens, rankings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarry.functions import text as t
from quarry.operators import tokens
from quarry.operators.papers import DATED_SQL, PAPERS_SQL, dated, papers, table
from quarry.plans import text_queries as q
from quarry.plans.clean_queries import LABELLED_SQL
from quarry.plans.registry import query

GET_DOMAIN = "CASE WHEN c = '' THEN 'unknown' ELSE split_part(c, '.', 1) END"
EXPLODED_SQL = f"{LABELLED_SQL}, tokens AS (SELECT id, unnest(cats) AS c FROM labelled)"
PRIMARY_SQL = f"{PAPERS_SQL}, primaries AS (SELECT *, {q.first_cat()} AS c FROM papers)"
YEARS_SQL = f"{DATED_SQL}, years AS (SELECT *, {q.submitted()} AS sy, {q.year('update_date')} AS uy FROM dated)"


def lengths():
    return {"title_chars": F.char_length(t.normalize_space("title")), "title_words": t.word_count("title"), "abstract_chars": F.char_length(t.normalize_space("abstract")), "abstract_words": t.word_count("abstract"), "label_count": F.size(t.categories("categories"))}


LENGTHS_SQL = {"title_chars": f"length({q.ws('title')})", "title_words": q.words("title"), "abstract_chars": f"length({q.ws('abstract')})", "abstract_words": q.words(), "label_count": f"len({q.cats()})"}
PCT = (0, 25, 50, 75, 90, 95, 99, 100)


def labelled(spark, d):
    return papers(spark, d).withColumn("cats", t.categories("categories"))


def years(spark, d):
    return dated(spark, d).select("*", t.submission_year("created").alias("sy"), t.first_year("update_date").alias("uy"))


@query("f1_column_overview", """WITH u AS (SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT field, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v = '') AS empty, count(*) FILTER (WHERE v <> '' AND trim(v) = '') AS blank, round(100.0 * count(*) FILTER (WHERE v IS NULL OR trim(v) = '') / count(*), 6) AS missing_pct FROM u GROUP BY 1""")
def column_overview(spark, d):
    u = table(spark, d, "documents").unpivot([], ["text", "lang", "source"], "field", "v")
    v = F.col("v")
    return u.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v == "").alias("empty"), F.count_if((v != "") & (F.trim(v) == "")).alias("blank"),
        F.round(100.0 * F.count_if(v.isNull() | (F.trim(v) == "")) / F.count("*"), 6).alias("missing_pct"),
    )


@query("f2_all_category_counts", f"WITH {EXPLODED_SQL} SELECT c AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM papers), 6) AS pct FROM tokens GROUP BY 1")
def all_categories(spark, d):
    p = labelled(spark, d)
    total = p.agg(F.count("*").alias("t"))
    return p.select(F.explode("cats").alias("category")).groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("category", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


def _primary(name, column, sql):
    @query(name, f"WITH {PRIMARY_SQL} SELECT {sql} AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM primaries GROUP BY 1")
    def run(spark, d):
        counts = papers(spark, d).select(column(t.primary_category(t.categories("categories"))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t"))), F.lit(True)).select("value", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


_primary("f3_primary_category_counts", lambda c: c, "c")
_primary("f4_primary_domain_counts", t.domain_or_unknown, GET_DOMAIN)


@query("f5_all_domain_counts", f"WITH {EXPLODED_SQL} SELECT {GET_DOMAIN} AS domain, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM tokens GROUP BY 1")
def all_domains(spark, d):
    counts = labelled(spark, d).select(F.explode("cats").alias("c")).groupBy(t.domain_or_unknown("c").alias("domain")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t"))), F.lit(True)).select("domain", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("f6_label_count_distribution", f"WITH {LABELLED_SQL} SELECT CAST(len(cats) AS INTEGER) AS labels, count(*) AS n FROM labelled WHERE len(cats) > 0 GROUP BY 1")
def label_counts(spark, d):
    return labelled(spark, d).where(F.size("cats") > 0).groupBy(F.size("cats").alias("labels")).agg(F.count("*").alias("n"))


@query("f7_category_combinations", f"WITH {LABELLED_SQL} SELECT array_to_string(cats, ' | ') AS combination, count(*) AS n FROM labelled WHERE len(cats) > 1 GROUP BY 1 ORDER BY n DESC, combination LIMIT 200")
def combinations(spark, d):
    return labelled(spark, d).where(F.size("cats") > 1).groupBy(F.array_join("cats", " | ").alias("combination")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(200)


@query("f8_malformed_categories", f"WITH {EXPLODED_SQL} SELECT c AS token, count(*) AS n FROM tokens WHERE NOT regexp_matches(c, '{t.CATEGORY}') GROUP BY 1")
def malformed(spark, d):
    return labelled(spark, d).select(F.explode("cats").alias("token")).where(~t.valid_category("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("f9_submission_months", f"WITH {YEARS_SQL} SELECT sy AS year, {q.month()} AS month, count(*) AS n FROM years GROUP BY 1, 2")
def months(spark, d):
    return years(spark, d).groupBy(F.col("sy").alias("year"), t.month_key("created").alias("month")).agg(F.count("*").alias("n"))


@query("f10_category_years", f"WITH {YEARS_SQL} SELECT category, domain, sy AS year, count(*) AS n FROM years WHERE sy IS NOT NULL AND uy IS NOT NULL GROUP BY 1, 2, 3")
def category_years(spark, d):
    return years(spark, d).where("sy IS NOT NULL AND uy IS NOT NULL").groupBy("category", "domain", F.col("sy").alias("year")).agg(F.count("*").alias("n"))


@query("f11_count_distributions", f"WITH {YEARS_SQL} SELECT 'authors' AS what, n_authors AS value, count(*) AS n FROM years GROUP BY 2 UNION ALL SELECT 'versions', n_versions, count(*) FROM years GROUP BY 2 UNION ALL SELECT 'update_year', uy, count(*) FROM years GROUP BY 2")
def distributions(spark, d):
    long = years(spark, d).select(F.col("n_authors").alias("authors"), F.col("n_versions").alias("versions"), F.col("uy").cast("long").alias("update_year")).unpivot([], ["authors", "versions", "update_year"], "what", "value")
    return long.groupBy("what", "value").agg(F.count("*").alias("n"))


@query("f12_update_lag", f"WITH {YEARS_SQL} SELECT greatest(uy - sy, 0) AS lag, count(*) AS n FROM years WHERE uy IS NOT NULL AND sy IS NOT NULL GROUP BY 1")
def lag(spark, d):
    return years(spark, d).where("uy IS NOT NULL AND sy IS NOT NULL").groupBy(F.greatest(F.col("uy") - F.col("sy"), F.lit(0)).alias("lag")).agg(F.count("*").alias("n"))


@query("f13_artifact_patterns", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (WHERE {q.has('html', k)}) AS n, round(100.0 * count(*) FILTER (WHERE {q.has('html', k)}) / count(*), 6) AS pct FROM pages" for k in t.ARTIFACTS))
def artifacts(spark, d):
    one = table(spark, d, "pages").agg(F.count("*").alias("t"), *[F.count_if(t.has("html", k)).alias(k) for k in t.ARTIFACTS])
    return one.unpivot(["t"], list(t.ARTIFACTS), "pattern", "n").select("pattern", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query("f14_domain_lengths", f"WITH {PRIMARY_SQL} SELECT {GET_DOMAIN} AS domain, count(*) AS n, " + ", ".join(f"quantile_cont({q.words()}, {p / 100}) AS p{p}" for p in (25, 50, 75, 90)) + " FROM primaries GROUP BY 1")
def domain_lengths(spark, d):
    p = papers(spark, d).select(t.domain_or_unknown(t.primary_category(t.categories("categories"))).alias("domain"), t.word_count("abstract").alias("w"))
    return p.groupBy("domain").agg(F.count("*").alias("n"), *[F.percentile("w", p_ / 100).alias(f"p{p_}") for p_ in (25, 50, 75, 90)])


@query("f15_percentiles", f"WITH {PAPERS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, " + ", ".join(f"quantile_cont(CAST({e} AS DOUBLE), {p / 100}) AS p{p}" for p in PCT) + " FROM papers" for k, e in LENGTHS_SQL.items()))
def percentiles(spark, d):
    wide = papers(spark, d).select(*[e.cast("double").alias(k) for k, e in lengths().items()])
    return wide.unpivot([], wide.columns, "metric", "v").groupBy("metric").agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in PCT])).alias("p")).select("metric", *[F.col("p")[k].alias(f"p{p}") for k, p in enumerate(PCT)])


@query("f16_summary", f"WITH {LABELLED_SQL} SELECT count(*) AS records, count(DISTINCT id) AS ids, count(*) FILTER (WHERE NOT regexp_matches({q.ws('id')}, '{t.IDENTIFIER}')) AS suspect_ids, count(DISTINCT cats[1]) AS primary_categories, round(100.0 * count(*) FILTER (WHERE len(cats) > 1) / count(*), 6) AS multilabel_pct FROM labelled")
def summary(spark, d):
    return labelled(spark, d).agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"), F.count_if(~t.valid_id("id")).alias("suspect_ids"), F.count_distinct(F.get("cats", 0)).alias("primary_categories"), F.round(100.0 * F.count_if(F.size("cats") > 1) / F.count("*"), 6).alias("multilabel_pct"))


@query("f17_lengths", f"WITH {PAPERS_SQL} SELECT id, " + ", ".join(f"CAST({e} AS INTEGER) AS {k}" for k, e in LENGTHS_SQL.items()) + " FROM papers")
def length_rows(spark, d):
    return papers(spark, d).select("id", *[e.alias(k) for k, e in lengths().items()])


@query("f18_threshold_counts", f"WITH {PAPERS_SQL} SELECT count(*) FILTER (WHERE {q.words()} <= 10) AS short_abstracts, count(*) FILTER (WHERE {q.words()} >= 300) AS long_abstracts, count(*) FILTER (WHERE {q.words('title')} <= 3) AS short_titles FROM papers")
def thresholds(spark, d):
    a, b = t.word_count("abstract"), t.word_count("title")
    return papers(spark, d).agg(F.count_if(a <= 10).alias("short_abstracts"), F.count_if(a >= 300).alias("long_abstracts"), F.count_if(b <= 3).alias("short_titles"))


SOURCE = "(title || ' ' || abstract)"
TOKENS_SQL = f"""{PAPERS_SQL},
all_tokens AS (SELECT 'raw' AS configuration, unnest({q.raw(SOURCE)}) AS token FROM papers UNION ALL SELECT 'plain', unnest({q.plain(SOURCE)}) FROM papers
  UNION ALL SELECT 'content', unnest(list_filter({q.plain(SOURCE)}, lambda w: NOT list_contains({q.STOP}, w))) FROM papers),
counted AS (SELECT configuration, token, count(*) AS n FROM all_tokens GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY configuration ORDER BY n DESC, token) AS rank FROM counted)"""


@query("g1_token_counts", f"WITH {TOKENS_SQL} SELECT configuration, token, n FROM counted")
def token_counts(spark, d):
    return tokens.token_counts(papers(spark, d))


def _pct(cond, of="1", total="count(*)"):
    return f"round(100.0 * sum(CASE WHEN {cond} THEN {of} ELSE 0 END) / {total}, 6)"


VOCABULARY_SQL = f"""{TOKENS_SQL}, m AS (SELECT configuration, count(*) AS vocab_size, CAST(sum(n) AS BIGINT) AS total_tokens, {_pct('n = 1')} AS hapax_vocab_pct, {_pct('n <= 2')} AS rare_le2_vocab_pct, {_pct('n <= 2', 'n', 'sum(n)')} AS rare_le2_mass_pct,
{_pct('n >= 1000')} AS common_vocab_pct, {_pct('n >= 1000', 'n', 'sum(n)')} AS common_mass_pct, {_pct(f'list_contains({q.STOP}, lower(token))', 'n', 'sum(n)')} AS stopword_pct, {_pct("regexp_matches(token, '^[0-9]+$')", 'n', 'sum(n)')} AS numeric_pct,
{_pct("regexp_matches(token, '[^A-Za-z0-9]')", 'n', 'sum(n)')} AS punct_pct, {_pct('rank <= 100', 'n', 'sum(n)')} AS top100_pct FROM ranked GROUP BY 1)"""


@query("g2_vocabulary_metrics", f"WITH {VOCABULARY_SQL} SELECT * FROM m")
def vocabulary(spark, d):
    found = tokens.vocabulary_metrics(tokens.token_counts(papers(spark, d))).drop("vocab_reduction_pct")
    return found.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else F.col(c) for c in found.columns])


@query("g3_vocabulary_reduction", f"WITH {VOCABULARY_SQL} SELECT configuration, round(100.0 * (1 - vocab_size / (SELECT vocab_size FROM m WHERE configuration = 'raw')), 6) AS vocab_reduction_pct FROM m")
def reduction(spark, d):
    return tokens.vocabulary_metrics(tokens.token_counts(papers(spark, d))).select("configuration", F.round("vocab_reduction_pct", 6).alias("vocab_reduction_pct"))


@query("g4_top_tokens", f"WITH {TOKENS_SQL} SELECT configuration, token, n, rank FROM ranked WHERE rank <= 2000")
def top(spark, d):
    return tokens.top_tokens(tokens.token_counts(papers(spark, d)))


@query("g5_rank_frequency", f"WITH {TOKENS_SQL} SELECT configuration, rank, n FROM ranked WHERE rank <= 1000")
def rank_frequency(spark, d):
    return tokens.top_tokens(tokens.token_counts(papers(spark, d)), 1000).select("configuration", "rank", "n")


SALES = "SELECT p_brand AS brand, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def sales(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("l_quantity").cast("long").alias("n"))


@query("i1_sorted_counts", f"{SALES} ORDER BY n DESC, brand")
def sorted_counts(spark, d):
    return sales(spark, d).orderBy(F.desc("n"), "brand")


@query("i2_multi_key_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey")
def multi_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.desc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"), "c_custkey")


@query("i3_head", f"{SALES} ORDER BY n DESC, brand LIMIT 10")
def head(spark, d):
    return sales(spark, d).orderBy(F.desc("n"), "brand").limit(10)


@query("i4_extremes", f"WITH {PAPERS_SQL}, l AS (SELECT id, CAST({q.words()} AS INTEGER) AS w FROM papers) (SELECT 'short' AS side, id, w FROM l ORDER BY w, id LIMIT 4) UNION ALL (SELECT 'long', id, w FROM l ORDER BY w DESC, id DESC LIMIT 4)")
def extremes(spark, d):
    w = papers(spark, d).select("id", t.word_count("abstract").alias("w"))
    return w.orderBy("w", "id").limit(4).select(F.lit("short").alias("side"), "id", "w").union(w.orderBy(F.desc("w"), F.desc("id")).limit(4).select(F.lit("long").alias("side"), "id", "w"))


@query("i5_first_rows", f"WITH {PAPERS_SQL} SELECT id, title FROM papers WHERE {q.words()} >= 50 ORDER BY line_no LIMIT 5")
def first_rows(spark, d):
    return papers(spark, d).where(t.word_count("abstract") >= 50).orderBy("line_no").limit(5).select("id", "title")


def ranked_sales(spark, d):
    """Brands are few (a table of groups), so one window over them is one small task."""
    one = Window.partitionBy(F.lit(1))
    order = one.orderBy(F.desc("n"), "brand")
    return sales(spark, d).select("brand", "n", F.row_number().over(order).alias("rank"), F.round(100.0 * F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(one), 6).alias("cumulative_pct"))


RANKED_SQL = f"s AS ({SALES}), r AS (SELECT brand, n, row_number() OVER (ORDER BY n DESC, brand) AS rank, round(100.0 * sum(n) OVER (ORDER BY n DESC, brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative_pct FROM s)"


@query("i6_cumulative_share", f"WITH {RANKED_SQL} SELECT * FROM r")
def cumulative(spark, d):
    return ranked_sales(spark, d)


@query("i7_coverage", f"WITH {RANKED_SQL} SELECT k, round(100.0 * sum(CASE WHEN rank <= k THEN n ELSE 0 END) / sum(n), 6) AS pct FROM r, (VALUES (5), (10), (20)) AS t(k) GROUP BY 1")
def coverage(spark, d):
    return ranked_sales(spark, d).withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).groupBy("k").agg(F.round(100.0 * F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("pct"))


@query("h2_yearly_share", f"WITH {YEARS_SQL}, g AS (SELECT category, sy AS year, count(*) AS n FROM years GROUP BY 1, 2) SELECT category, year, n, round(100.0 * n / sum(n) OVER (PARTITION BY year), 6) AS pct FROM g")
def yearly_share(spark, d):
    g = years(spark, d).groupBy("category", F.col("sy").alias("year")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


@query("i12_first_last_share", f"WITH {YEARS_SQL}, g AS (SELECT category, sy AS year, count(*) AS n FROM years GROUP BY 1, 2) SELECT category, arg_min(n, year) AS first_n, arg_max(n, year) AS last_n FROM g GROUP BY 1")
def first_last(spark, d):
    g = years(spark, d).groupBy("category", F.col("sy").alias("year")).agg(F.count("*").alias("n"))
    return g.groupBy("category").agg(F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"))


@query("i13_union", "SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier")
def union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind")))


@query("i14_set_difference", "(SELECT c_nationkey AS k, 'only customers' AS side FROM customer EXCEPT SELECT s_nationkey, 'only customers' FROM supplier) UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)")
def set_difference(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).withColumn("side", F.lit("only customers")).union(c.intersect(s).withColumn("side", F.lit("both")))
