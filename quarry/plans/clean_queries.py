"""Queries of scans, cleaning, deduplication and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import clean
from quarry.operators.papers import DATED_SQL, PAPERS_SQL, dated, papers, table
from quarry.plans import text_queries as q
from quarry.plans.registry import query
from quarry.sources import records

JUDGED_SQL = f"""{PAPERS_SQL},
marked AS (SELECT *, {q.ws("id")} AS nid, {q.key()} AS ckey, ({q.ws("id")} = '' OR {q.ws("title")} = '' OR {q.ws("abstract")} = '' OR {q.ws("categories")} = '') AS missing FROM papers),
ids AS (SELECT *, row_number() OVER (PARTITION BY missing, nid ORDER BY line_no) AS nth_id FROM marked),
keys AS (SELECT *, row_number() OVER (PARTITION BY missing, nth_id = 1, ckey ORDER BY line_no) AS nth_key FROM ids),
judged AS (SELECT *, CASE WHEN missing THEN 'missing_field' WHEN nth_id > 1 THEN 'duplicate_id' WHEN nth_key > 1 THEN 'duplicate_content'
  WHEN {q.words()} <= 10 THEN 'short_abstract' WHEN {q.placeholder()} THEN 'placeholder' ELSE 'kept' END AS drop_reason FROM keys)"""
LABELLED_SQL = f"{PAPERS_SQL}, labelled AS (SELECT *, {q.cats()} AS cats FROM papers)"


@query("a1_json_decode", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE props IS NULL OR NOT json_valid(props)) AS bad FROM events GROUP BY 1")
def json_decode(spark, d):
    return records.decode_counts(table(spark, d, "events").select("event_type", F.col("props").alias("value")), ["event_type"])


@query("a4_projected_scan", "SELECT doc_id, lang FROM documents")
def projected_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("a5_split_load", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def split_load(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("a7_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("a12_upsert", """WITH b AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS batch FROM customer UNION ALL SELECT o_custkey, max(o_totalprice), 1 FROM orders GROUP BY 1)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC, v DESC) AS n FROM b) WHERE n = 1""")
def upsert(spark, d):
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return clean.upsert(held, new, ["k"], "v").select("k", "v")


@query("c1_required_fields", f"WITH {JUDGED_SQL} SELECT id FROM judged WHERE NOT missing")
def required(spark, d):
    return clean.judged(papers(spark, d)).where("drop_reason <> 'missing_field'").select("id")


@query("c2_primary_category_filter", f"WITH {PAPERS_SQL} SELECT count(*) AS dropped FROM papers WHERE {q.first_cat()} = ''")
def primary_filter(spark, d):
    return papers(spark, d).where(t.primary_category(t.categories("categories")) == "").agg(F.count("*").alias("dropped"))


@query("c3_short_abstracts", f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE {q.words()} <= 10")
def short(spark, d):
    return papers(spark, d).where(t.word_count("abstract") <= clean.SHORT).select("id")


@query("c4_placeholders", f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE {q.placeholder()}")
def placeholders(spark, d):
    return papers(spark, d).where(t.is_placeholder("abstract")).select("id")


@query("c5_drop_manifest", f"WITH {JUDGED_SQL} SELECT drop_reason, count(*) AS n FROM judged GROUP BY 1")
def manifest(spark, d):
    return clean.manifest(papers(spark, d))


@query("c6_clean_records", f"""WITH {JUDGED_SQL} SELECT line_no, nid AS id, {q.ws("title")} AS title, {q.ws("abstract")} AS abstract, {q.ws("title")} || chr(10) || {q.ws("abstract")} AS text_input,
{q.ws("categories")} AS categories, {q.first_cat()} AS primary_category, split_part({q.first_cat()}, '.', 1) AS primary_domain, CAST({q.words()} AS INTEGER) AS abstract_word_len, len({q.cats()}) > 1 AS is_multilabel
FROM judged WHERE drop_reason = 'kept'""")
def clean_records(spark, d):
    return clean.cleaned(papers(spark, d))


@query("c7_eligible_categories", "SELECT source AS category, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 30")
def eligible(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n")).where("n >= 30")


@query("c8_non_noise", "SELECT vec_id, label FROM embeddings WHERE label - 2 >= 0")
def non_noise(spark, d):
    return table(spark, d, "embeddings").where("label - 2 >= 0").select("vec_id", "label")


@query("c10_recent", f"WITH {DATED_SQL}, y AS (SELECT id, {q.submitted()} AS y FROM dated) SELECT id, y AS year FROM y WHERE y >= (SELECT max(y) - 4 FROM y)")
def recent(spark, d):
    years = dated(spark, d).select("id", t.submission_year("created").alias("year"))
    return years.join(F.broadcast(years.agg((F.max("year") - 4).alias("least"))), F.lit(True)).where("year >= least").select("id", "year")


@query("c11_top_domains", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5)")
def top_domains(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(docs.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5), "source", "left_semi").select("doc_id", "source")


@query("c12_report_columns", "SELECT c_name AS customer, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer")
def report_columns(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance"))


@query("c13_successful", "SELECT o_orderkey FROM orders WHERE coalesce(lower(o_orderstatus) = 'f', false)")
def successful(spark, d):
    return table(spark, d, "orders").where(F.coalesce(F.lower("o_orderstatus") == "f", F.lit(False))).select("o_orderkey")


@query("c14_overflow_bins", f"WITH {DATED_SQL} SELECT CASE WHEN n_authors >= 6 THEN '6+' ELSE CAST(n_authors AS VARCHAR) END AS bin, count(*) AS n FROM dated GROUP BY 1")
def bins(spark, d):
    return dated(spark, d).groupBy(F.when(F.col("n_authors") >= 6, "6+").otherwise(F.col("n_authors").cast("string")).alias("bin")).agg(F.count("*").alias("n"))


@query("c15_outcome", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Succeeded' WHEN o_orderstatus = 'O' THEN 'Missing or failed' ELSE 'Disabled' END AS outcome FROM orders")
def outcome(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "Succeeded").when(s == "O", "Missing or failed").otherwise("Disabled").alias("outcome"))


@query("c16_melt", "SELECT l_orderkey, l_linenumber, 'l_tax' AS metric, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def melt(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "metric", "value")


@query("d1_first_by_id", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_by_id(spark, d):
    """A line number that occurs twice in an order goes to the row that comes first in the files, by their names."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *place)
    return lines.withColumn("_n", clean.first_of(["l_orderkey"], [F.asc_nulls_last("l_linenumber"), "_file", "_row"])).where("_n = 1").drop("_n", "_file", "_row")


@query("d2_first_by_content", f"WITH {JUDGED_SQL} SELECT id FROM judged WHERE NOT missing AND nth_id = 1 AND nth_key = 1")
def first_by_content(spark, d):
    return clean.judged(papers(spark, d)).where("drop_reason NOT IN ('missing_field', 'duplicate_id', 'duplicate_content')").select("id")


@query("d3_duplicate_summary", f"WITH {PAPERS_SQL}, g AS (SELECT {q.joined(q.plain('title'))} AS v, count(*) AS n FROM papers GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS duplicated_values, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_records FROM g")
def duplicate_summary(spark, d):
    return clean.duplicate_summary(papers(spark, d), t.plain_title("title"))


@query("d4_top_duplicates", f"WITH {PAPERS_SQL} SELECT {q.key()} AS value, count(*) AS n FROM papers GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 20")
def top_duplicates(spark, d):
    return clean.duplicate_groups(papers(spark, d), t.content_key("title", "abstract")).orderBy(F.desc("n"), "value").limit(20)


@query("d5_duplicate_examples", f"WITH {PAPERS_SQL}, g AS (SELECT title AS value, count(*) AS n FROM papers GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 20) SELECT g.value, g.n, arg_min(id, line_no) AS first_id FROM papers JOIN g ON title = g.value GROUP BY 1, 2")
def duplicate_examples(spark, d):
    return clean.duplicate_examples(papers(spark, d), F.col("title"))


@query("d6_duplicate_ids", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 1 ORDER BY event_id LIMIT 10")
def duplicate_ids(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return e.withColumn("_n", clean.first_of(["user_id"], ["event_id"])).where("_n > 1").drop("_n").orderBy("event_id").limit(10)


@query("d7_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def keep_last(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")).select("user_id", "x.event_id", "x.event_type")
