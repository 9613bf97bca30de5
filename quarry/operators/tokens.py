"""Token and vocabulary statistics under three tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions import text as t
from quarry.functions.stopwords import STOP_WORDS
from quarry.operators.vectors import small
from quarry.sources.shared import materialize


def token_counts(records: DataFrame) -> DataFrame:
    """configuration, token, n. One scan: raw and plain tokens of a record are exploded together and counted map-side; content tokens are the counted plain ones without stop words."""
    source = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    both = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("configuration"), f(source).alias("tokens")) for k, f in (("raw", t.raw_tokens), ("plain", t.plain_tokens))])).alias("x"))
    found = both.select("x.configuration", F.explode("x.tokens").alias("token"))
    counts = found.groupBy("configuration", "token").agg(F.count("*").alias("n"))
    content = (F.col("configuration") == "plain") & ~F.col("token").isin(*STOP_WORDS)
    return counts.select(F.explode(F.when(content, F.array(F.lit("plain"), F.lit("content"))).otherwise(F.array("configuration"))).alias("configuration"), "token", "n")


def top_tokens(counts: DataFrame, limit: int = 2000) -> DataFrame:
    """The limit most frequent tokens of each configuration with their rank; ties by token."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("configuration").orderBy(F.desc("n"), "token"))).where(F.col("rank") <= limit)


def vocabulary_metrics(counts: DataFrame, frequent: int = 1000) -> DataFrame:
    counts, n = materialize(counts, "token-counts"), F.col("n")  # read three times
    share = lambda cond, of, total: 100.0 * F.sum(F.when(cond, of).otherwise(0)) / total
    types, tokens = F.count("*"), F.sum("n")
    top = top_tokens(counts, 100).groupBy("configuration").agg(F.sum("n").alias("top100"))
    found = counts.groupBy("configuration").agg(
        types.alias("vocab_size"), tokens.alias("total_tokens"), share(n == 1, 1, types).alias("hapax_vocab_pct"), share(n <= 2, 1, types).alias("rare_le2_vocab_pct"), share(n <= 2, n, tokens).alias("rare_le2_mass_pct"),
        share(n >= frequent, 1, types).alias("common_vocab_pct"), share(n >= frequent, n, tokens).alias("common_mass_pct"), share(F.lower("token").isin(*STOP_WORDS), n, tokens).alias("stopword_pct"),
        share(F.col("token").rlike("^[0-9]+$"), n, tokens).alias("numeric_pct"), share(F.col("token").rlike("[^A-Za-z0-9]"), n, tokens).alias("punct_pct"),
    )
    raw = found.where("configuration = 'raw'").select(F.col("vocab_size").alias("raw_size"))
    return found.join(top, "configuration").join(raw, F.lit(True)).select(
        *found.columns, (100.0 * F.col("top100") / F.col("total_tokens")).alias("top100_pct"), (100.0 * (1 - F.col("vocab_size") / F.col("raw_size"))).alias("vocab_reduction_pct")
    )


def term_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms (array of term, tf) of words of two characters or more. Terms are counted within their row; only rows of an id that occurs again are brought together before."""
    found = records.select(*keys, F.filter(t.sparse_tokens("text"), lambda w: F.char_length(w) >= 2).alias("tokens"))
    rows, ids = records.agg(F.count("*"), F.count_distinct(keys[0])).first()
    if rows != ids:
        found = found.groupBy(*keys).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return materialize(found.select(*keys, t.counted(F.col("tokens")).alias("terms")), "terms")


def tfidf(records: DataFrame, fit: DataFrame | None = None, min_df: int = 2, max_features: int = 50_000) -> DataFrame:
    """id, term, weight in long form: 1 + ln tf, smoothed idf plus one, rows of unit length. Vocabulary and idf come from fit (records by default)."""
    terms = lambda rows: term_counts(rows, ["id"]).select("id", F.explode("terms").alias("x")).select("id", "x.term", "x.tf")
    base = records if fit is None else fit
    n, own = base.count(), terms(records)
    seen = (own if fit is None else terms(fit)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocabulary = seen.orderBy(F.desc("total"), "term").limit(max_features)
    idf = materialize(vocabulary.select("term", (F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    weighted = own.join(small(idf), "term").select("id", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighted.select("id", "term", (F.col("w") / norm).alias("weight"))
