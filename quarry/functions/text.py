"""Text functions as column expressions: whitespace, categories, LaTeX, tokens, dates, hashes, labels.

Every function takes and returns Columns, so it stays inside the scan's code generation. Null text counts as empty.
Classes are spelled out, because \\w and \\s are ASCII in Java: WORD and SPACE are the Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.stopwords import STOP_WORDS

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"\p{L}\p{N}_"
URL = r"https?://[^\t-\r\x1c-\x20\x85\p{Z}]+|www\.[^\t-\r\x1c-\x20\x85\p{Z}]+"
EMAIL = rf"[{WORD}][{WORD}.\-]*@[{WORD}.\-]+\.[{WORD}]+"
ENVIRONMENT, MATH = r"\\(?:begin|end)\{[^{}]*\}", r"\$[^$]+\$"
COMMAND = r"\\[A-Za-z]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
YEAR = r"((?:19|20)[0-9]{2})"
CATEGORY = r"^[A-Za-z\-]+(?:\.[A-Za-z\-]+)?$"
IDENTIFIER = r"^(?:[a-z\-]+(?:\.[A-Za-z\-]+)?/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})$"
RAW_TOKEN = r"[A-Za-z0-9_+\-.']+"
ARTIFACTS = {
    "html": r"<[^>]+>",
    "latex": r"\\[A-Za-z]+|\$[^$]+\$|\\\(|\\\)|\\\[|\\\]",
    "url": r"https?://|www\.",
    "email": r"[A-Za-z0-9_][A-Za-z0-9_.%\-]*@[A-Za-z0-9_.\-]+\.[A-Za-z]{2,}",
    "punctuation": r"[!?.,;:]{4,}",
    "withdrawn": r"(?i)withdrawn|retracted",
    "non_ascii": r"[^\x00-\x7F]",
    "newline": r"\n",
}
PLACEHOLDERS = r"withdrawn|retracted"
PLACEHOLDER_WORDS = 60


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE + "+", " "))


def categories(x: Column | str) -> Column:
    return F.filter(F.split(normalize_space(x), " "), lambda t: t != "")


def primary_category(labels: Column | str) -> Column:
    return F.coalesce(F.get(_c(labels), 0), F.lit(""))


def primary_domain(category: Column | str) -> Column:
    return F.substring_index(_c(category), ".", 1)


def domain_or_unknown(category: Column | str) -> Column:
    return F.when(_c(category) == "", "unknown").otherwise(primary_domain(category))


def text_input(title: Column | str, abstract: Column | str) -> Column:
    return F.regexp_replace(F.concat_ws("\n", normalize_space(title), normalize_space(abstract)), r"^\n+|\n+$", "")


def strip_latex(x: Column | str) -> Column:
    out = normalize_space(x)
    for pattern in (ENVIRONMENT, MATH, COMMAND, r"[{}]"):
        out = F.regexp_replace(out, pattern, " ")
    return normalize_space(out)


def content_key(title: Column | str, abstract: Column | str) -> Column:
    """Key of equal content: punctuation and case of the title, case and white space of the abstract do not count."""
    plain = normalize_space(F.regexp_replace(F.lower(normalize_space(title)), r"[^\p{L}\p{N}]+", " "))
    return F.concat_ws("\n", plain, F.lower(normalize_space(abstract)))


def word_count(x: Column | str) -> Column:
    text = normalize_space(x)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def is_placeholder(x: Column | str) -> Column:
    text = F.lower(normalize_space(x))
    return (text == "") | ((F.size(F.split(text, " ")) <= PLACEHOLDER_WORDS) & text.rlike(PLACEHOLDERS))


def first_year(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(x), F.lit("")), YEAR, 1), F.lit("")).cast("int")


def mail_date(x: Column | str, part: int) -> Column:
    """Part 1 (month name) or 2 (year) of a mail date, in the sender's zone; null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"[0-9]{1,2} ([A-Z][a-z]{2}) ([0-9]{4})", part), F.lit(""))


def submission_year(created: Column | str) -> Column:
    return F.coalesce(mail_date(created, 2).cast("int"), first_year(created))


def month_key(created: Column | str) -> Column:
    month = F.ceil(F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), mail_date(created, 1)) / 3)
    return F.when(mail_date(created, 2).isNotNull(), F.concat_ws("-", mail_date(created, 2), F.lpad(month.cast("string"), 2, "0")))


def sparse_tokens(x: Column | str) -> Column:
    """Words of the text without LaTeX. What only joins or trims white space is left out: words are cut at all that is no WORD."""
    out = F.coalesce(_c(x), F.lit(""))
    for pattern in (ENVIRONMENT, MATH, COMMAND):
        out = F.regexp_replace(out, pattern, " ")
    return F.filter(F.split(F.lower(out), rf"[^{WORD}]+"), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def counted(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens, sorted by term: ends of runs in the sorted array."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda _, i: i + 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return F.get(F.transform(F.array(ends), lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("tf")))), 0)

    return F.get(F.transform(F.array(F.sort_array(tokens)), runs), 0)  # each array is bound to a variable, so it is made once a row


def sparse_clean(x: Column | str) -> Column:
    return F.array_join(sparse_tokens(x), " ")


def dense_clean(x: Column | str) -> Column:
    return normalize_space(F.regexp_replace(F.regexp_replace(normalize_space(x), URL, " "), EMAIL, " "))


def clip(x: Column | str, width: int) -> Column:
    text = normalize_space(x)
    return F.when(F.char_length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def raw_tokens(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(RAW_TOKEN), F.lit(0)), F.lower)


def plain_tokens(x: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), rf"[^a-z0-9\t-\r\x1c-\x20\x85\p{{Z}}]", " "), SPACE + "+"), lambda t: t != "")


def content_tokens(x: Column | str) -> Column:
    return F.filter(plain_tokens(x), lambda t: ~t.isin(*STOP_WORDS))


def plain_title(x: Column | str) -> Column:
    return F.array_join(plain_tokens(x), " ")


def has(x: Column | str, artifact: str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(ARTIFACTS[artifact])


def issue_tags(title: Column | str, abstract: Column | str) -> Column:
    """Ordered names of the artifacts that a record shows; the title's LaTeX is sought in the normalised title."""
    found = [F.when(has(normalize_space(title), "latex"), "title_latex"), F.when(has(title, "newline"), "title_newline")]
    return F.array_compact(F.array(*found, *[F.when(has(abstract, k), f"abstract_{k}") for k in ARTIFACTS]))


def valid_id(x: Column | str) -> Column:
    return F.coalesce(normalize_space(x).rlike(IDENTIFIER), F.lit(False))


def valid_category(x: Column | str) -> Column:
    return _c(x).rlike(CATEGORY)


def stable_int(x: Column | str) -> Column:
    """48-bit integer of the text's SHA-1."""
    return F.conv(F.substring(F.sha1(F.coalesce(_c(x), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def pipeline_label(embedding: Column | str, clustering: Column | str) -> Column:
    return F.concat(F.upper(_c(embedding)), F.lit(" + "), F.initcap(_c(clustering)))


def search_label(k: Column | str, min_cluster_size: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("k="), _c(k).cast("string")), F.concat(F.lit("min_cluster_size="), _c(min_cluster_size).cast("string")), F.lit("default"))


def as_bool(x: Column | str) -> Column:
    return F.coalesce(F.lower(_c(x)) == "true", F.lit(False))
