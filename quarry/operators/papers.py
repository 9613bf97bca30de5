"""Stand-in corpora of records (id, title, abstract, categories, dates) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, id, title (first line), abstract (the rest), categories (language and source)."""
    split = F.instr("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.when(split > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("").alias("abstract"), F.concat_ws(" ", "lang", "source").alias("categories"), "text",
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated records: id, created (mail date), update_date (last shipment), n_authors (lines), n_versions (suppliers), category, domain."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("last"), F.count("*").alias("n_authors"), F.count_distinct("l_suppkey").alias("n_versions"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("created"), F.lower(F.translate("o_orderpriority", "123456789- ", "")).alias("category"), F.lower("o_orderstatus").alias("domain"),
    )
    return orders.join(lines, "id").select("id", "created", F.date_format("last", "yyyy-MM-dd").alias("update_date"), "n_authors", "n_versions", "category", "domain")


PAPERS_SQL = """papers AS (SELECT doc_id AS line_no, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract,
  lang || ' ' || source AS categories, text FROM documents)"""

DATED_SQL = """lines AS (SELECT l_orderkey AS id, max(l_shipdate) AS last, count(*) AS n_authors, count(DISTINCT l_suppkey) AS n_versions FROM lineitem GROUP BY 1),
dated AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S') || ' GMT' AS created, strftime(last, '%Y-%m-%d') AS update_date,
  n_authors, n_versions, lower(regexp_replace(o_orderpriority, '[0-9 -]', '', 'g')) AS category, lower(o_orderstatus) AS domain
  FROM orders JOIN lines ON o_orderkey = lines.id)"""
