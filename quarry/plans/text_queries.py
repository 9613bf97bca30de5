"""One query for each text function, over the stand-in records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions.stopwords import STOP_WORDS
from quarry.operators.papers import DATED_SQL, PAPERS_SQL, dated, papers, table
from quarry.plans.registry import query

S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_S = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
W = r"\p{L}\p{N}_"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _re(p: str) -> str:
    return p.replace(r"[^\t-\r\x1c-\x20\x85\p{Z}]", NOT_S).replace(r"\x85", r"\x{85}").replace("'", "''")


def ws(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '{S}+', ' ', 'g'))"


def latex(x: str) -> str:
    out = ws(x)
    for p in (t.ENVIRONMENT, t.MATH, t.COMMAND, r"[{}]"):
        out = f"regexp_replace({out}, '{_re(p)}', ' ', 'g')"
    return ws(out)


def cats(x: str = "categories") -> str:
    return f"list_filter(string_split({ws(x)}, ' '), lambda c: c <> '')"


def first_cat(x: str = "categories") -> str:
    return f"coalesce({cats(x)}[1], '')"


def key(title: str = "title", abstract: str = "abstract") -> str:
    plain = ws(rf"regexp_replace(lower({ws(title)}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')")
    return f"{plain} || chr(10) || lower({ws(abstract)})"


def words(x: str = "abstract") -> str:
    return f"(CASE WHEN {ws(x)} = '' THEN 0 ELSE len(string_split({ws(x)}, ' ')) END)"


def placeholder(x: str = "abstract") -> str:
    return f"({ws(x)} = '' OR (len(string_split({ws(x)}, ' ')) <= 60 AND regexp_matches(lower({ws(x)}), '{t.PLACEHOLDERS}')))"


def sparse(x: str) -> str:
    clean = rf"regexp_replace(lower({latex(x)}), '[^{W}\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', ' ', 'g')"
    return rf"list_filter(regexp_split_to_array({clean}, '{S}+'), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


def plain(x: str) -> str:
    clean = rf"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', ' ', 'g')"
    return rf"list_filter(regexp_split_to_array({clean}, '{S}+'), lambda w: w <> '')"


def raw(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{_re(t.RAW_TOKEN)}'), lambda w: lower(w))"


def dense(x: str) -> str:
    return ws(f"regexp_replace(regexp_replace({ws(x)}, '{_re(t.URL)}', ' ', 'g'), '{_re(t.EMAIL)}', ' ', 'g')")


def has(x: str, artifact: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '{_re(t.ARTIFACTS[artifact])}')"


def tags(title: str = "title", abstract: str = "abstract") -> str:
    found = [f"CASE WHEN {has(ws(title), 'latex')} THEN 'title_latex' END", f"CASE WHEN {has(title, 'newline')} THEN 'title_newline' END", *(f"CASE WHEN {has(abstract, k)} THEN 'abstract_{k}' END" for k in t.ARTIFACTS)]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


def year(x: str) -> str:
    return f"CAST(nullif(regexp_extract(coalesce({x}, ''), '{t.YEAR}', 1), '') AS INTEGER)"


def mail(x: str, part: int) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), '[0-9]{{1,2}} ([A-Z][a-z]{{2}}) ([0-9]{{4}})', {part}), '')"


def submitted(x: str = "created") -> str:
    return f"coalesce(CAST({mail(x, 2)} AS INTEGER), {year(x)})"


def month(x: str = "created") -> str:
    return f"{mail(x, 2)} || '-' || lpad(CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', {mail(x, 1)}) + 2) // 3 AS VARCHAR), 2, '0')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def _papers(name: str, column, sql: str) -> None:
    query(name, f"WITH {PAPERS_SQL} SELECT id, {sql} AS value FROM papers")(lambda spark, d: papers(spark, d).select("id", column().alias("value")))


def _pages(name: str, column, sql: str) -> None:
    query(name, f"SELECT page_id, {sql} AS value FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", column().alias("value")))


def _dated(name: str, column, sql: str) -> None:
    query(name, f"WITH {DATED_SQL} SELECT id, {sql} AS value FROM dated")(lambda spark, d: dated(spark, d).select("id", column().alias("value")))


_papers("b1_normalize_space", lambda: t.normalize_space("text"), ws("text"))
_papers("b2_parse_categories", lambda: F.array_join(t.categories("categories"), "|"), f"array_to_string({cats()}, '|')")
_papers("b3_primary_category", lambda: t.primary_category(t.categories("categories")), first_cat())
_papers("b4_primary_domain", lambda: t.primary_domain(F.concat("id", F.lit(".x."), "categories")), "split_part(id || '.x.' || categories, '.', 1)")
_papers("b5_domain_or_unknown", lambda: t.domain_or_unknown(F.when(F.col("line_no") % 7 == 0, "").otherwise(F.col("categories"))), "CASE WHEN line_no % 7 = 0 OR categories = '' THEN 'unknown' ELSE split_part(categories, '.', 1) END")
_papers("b6_text_input", lambda: t.text_input("title", "abstract"), f"regexp_replace({ws('title')} || chr(10) || {ws('abstract')}, '^\\n+|\\n+$', '', 'g')")
_papers("b7_strip_latex", lambda: t.strip_latex("text"), latex("text"))
_papers("b8_content_key", lambda: F.sha1(t.content_key("title", "abstract").cast("binary")), f"sha1({key()})")
_papers("b9_word_count", lambda: t.word_count("abstract"), words())
_papers("b10_is_placeholder", lambda: t.is_placeholder("abstract"), placeholder())
_dated("b11_submission_year", lambda: t.submission_year("created"), submitted())
_dated("b12_update_year", lambda: t.first_year("update_date"), year("update_date"))
_papers("b13_sparse_clean", lambda: F.sha1(t.sparse_clean("text").cast("binary")), f"sha1({joined(sparse('text'))})")
_pages("b14_dense_clean", lambda: t.dense_clean("html"), dense("html"))
_papers("b15_npmi_tokens", lambda: F.size(t.sparse_tokens("text")), f"len({sparse('text')})")
_papers("b16_clip", lambda: t.clip("text", 80), f"CASE WHEN length({ws('text')}) > 80 THEN left({ws('text')}, 77) || '...' ELSE {ws('text')} END")
_papers("b17_raw_tokens", lambda: F.sha1(F.array_join(t.raw_tokens("text"), " ").cast("binary")), f"sha1({joined(raw('text'))})")
_papers("b18_plain_tokens", lambda: F.sha1(F.array_join(t.plain_tokens("text"), " ").cast("binary")), f"sha1({joined(plain('text'))})")
_papers("b19_content_tokens", lambda: F.size(t.content_tokens("text")), f"len(list_filter({plain('text')}, lambda w: NOT list_contains({STOP}, w)))")
_papers("b20_plain_title", lambda: t.plain_title("title"), joined(plain("title")))
_pages("b21_artifacts", lambda: F.concat_ws(",", *[t.has("html", k).cast("string") for k in t.ARTIFACTS]), " || ',' || ".join(f"CAST({has('html', k)} AS VARCHAR)" for k in t.ARTIFACTS))
_pages("b22_issue_tags", lambda: F.array_join(t.issue_tags("url", "html"), ", "), f"array_to_string({tags('url', 'html')}, ', ')")
_papers("b23_valid_id", lambda: t.valid_id(F.concat(F.lpad(F.col("id"), 4, "1"), F.lit("."), F.lpad("id", 5, "0"))), rf"regexp_matches(lpad(id, 4, '1') || '.' || lpad(id, 5, '0'), '{t.IDENTIFIER}')")
_papers("b24_valid_category", lambda: F.concat_ws(",", t.valid_category(F.split("categories", " ")[0]).cast("string"), t.valid_category(F.split("categories", " ")[1]).cast("string")), f"CAST(regexp_matches(string_split(categories, ' ')[1], '{t.CATEGORY}') AS VARCHAR) || ',' || CAST(regexp_matches(string_split(categories, ' ')[2], '{t.CATEGORY}') AS VARCHAR)")
_papers("b25_stable_int", lambda: t.stable_int("text"), "CAST(('0x' || substr(sha1(text), 1, 12)) AS BIGINT)")
_dated("b27_parse_date", lambda: F.date_format(F.try_to_date("update_date", "yyyy-MM-dd"), "yyyyMMdd"), "strftime(try_strptime(update_date, '%Y-%m-%d'), '%Y%m%d')")
_dated("b28_month_key", lambda: t.month_key("created"), month())
_papers("b29_pipeline_label", lambda: t.pipeline_label(F.split("categories", " ")[0], F.split("categories", " ")[1]), "upper(string_split(categories, ' ')[1]) || ' + ' || upper(left(string_split(categories, ' ')[2], 1)) || lower(substr(string_split(categories, ' ')[2], 2))")
_papers("b30_search_label", lambda: t.search_label(F.when(F.col("line_no") % 3 == 0, F.col("line_no")), F.when(F.col("line_no") % 3 == 1, F.col("line_no"))), "CASE line_no % 3 WHEN 0 THEN 'k=' || line_no WHEN 1 THEN 'min_cluster_size=' || line_no ELSE 'default' END")
_papers("b31_as_bool", lambda: t.as_bool(F.when(F.col("line_no") % 3 == 0, "True").when(F.col("line_no") % 3 == 1, "no")), "line_no % 3 = 0")


@query("b26_content_hash", f"WITH {PAPERS_SQL} SELECT count(*) AS groups, max(n) AS largest FROM (SELECT {key()} AS k, count(*) AS n FROM papers GROUP BY 1)")
def content_hash(spark, d):
    """Equal content by a 64-bit hash, with the content itself as tie-breaker, so that a collision can't merge groups."""
    k = t.content_key("title", "abstract")
    return papers(spark, d).groupBy(F.xxhash64(k), k).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest"))
