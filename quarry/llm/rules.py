"""Quality rules as a short-circuit cascade (DataFrame expressions only).

A rule is an expression over statistics of a text. `plan_cascade` counts what each rule rejects on a sample of all rows,
and times it together with the statistics that it needs; it orders the rules by rejection per cost.
`cascade_verdict` is the nested conditional in that order: a rule runs only where all rules before it let the row pass.
Over columns of statistics (`quality_rules`) it decides alone; over a text (`verdict_of`) a statistic is not computed
either where an earlier rule rejects. The order never changes the verdict, only its cost.

Null texts have no words and count as empty; empty texts fail the word minimum; texts are judged whole, whatever their
length; repeated rows are judged one by one; rules that tie in rejection per cost keep the order in which they are given;
extra columns pass through, unless a column has the name of a statistic, which is then replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import SPACE, documents, materialize

#: Words of a window, and windows that repeat within a text.
WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _within(value: Column, f) -> Column:
    """f(value), with value bound once as a lambda variable: higher-order functions would otherwise evaluate it per element."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text.

    Windows are hashed; only texts with equal hashes go on: (hash, start) pairs are sorted, neighbours with equal
    hashes are compared as word lists, and the covered words are counted over the sorted starts. n log n in a text.
    """
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def doubled(hashes: Column, k: int) -> Column:
        """From hashes of k words, those of 2 k words (and what goes over the end)."""
        return _within(hashes, lambda a: F.zip_with(a, F.slice(a, k + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for k in (1, 2, 4):
        hashes = doubled(hashes, k)

    def exact(ws: Column, hs: Column) -> Column:
        text = lambda s: F.array_join(F.slice(ws, s["i"], WINDOW), " ")
        pairs = F.sort_array(F.zip_with(hs, starts, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(ps: Column) -> Column:
            same = lambda a, b: (a["h"] == b["h"]) & (text(a) == text(b))
            before = lambda x, k: F.when(k == 0, F.lit(False)).otherwise(same(x, F.get(ps, k - 1)))
            after = lambda x, k: F.when(k == F.size(ps) - 1, F.lit(False)).otherwise(same(x, F.get(ps, k + 1)))
            return F.filter(F.transform(ps, lambda x, k: F.when(F.coalesce(before(x, k) | after(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull())

        def covered(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda i, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), i - F.get(at, k - 1)))), F.lit(0).cast("long"), lambda s, x: s + x
            )

        return _within(pairs, lambda ps: _within(F.sort_array(found(ps)), covered))

    zero = F.lit(0).cast("long")
    count = _within(F.slice(hashes, 1, n - (WINDOW - 1)), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(exact(words, hs)))
    return F.when(n < WINDOW + 1, zero).otherwise(count)


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE, -1), lambda w: w != "")


def _statistic(t: Column, words: Column) -> Callable[[str], Column]:
    """Statistics, all long, as expressions over a text and its words."""
    less = lambda chars: (F.char_length(t) - F.char_length(F.regexp_replace(t, chars, ""))).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of = {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": lambda: less(r"[#*$%&|<>]+"),
        "n_dup_lines": lambda: _within(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": lambda: _repeat_words(words, F.size(words)),
        "n_upper": lambda: less("[A-Z]+"),
        "n_pipes": lambda: less("[|]+"),
    }
    return lambda name: of[name]()


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_pipes (all long)."""
    names = (*STATISTICS, "n_upper", "n_pipes")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*names, "_words", "_text")]
    wide = docs.select(*keep, _text(text).alias("_text")).withColumn("_words", _words(F.col("_text")))
    of = _statistic(F.col("_text"), F.col("_words"))
    return wide.select(*keep, *[of(c).alias(c) for c in names])


@dataclass(frozen=True)
class Rule:
    """rejects: given what turns the name of a statistic into its column, true where the rule rejects a row."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda c: c("n_words") < 20),
        Rule("repeated_windows", lambda c: 100 * c("n_repeat_words") > 30 * c("n_words")),
    ]


def production_rules() -> list[Rule]:
    """The rules of op4: two base rules, and what the verdict adds to them."""
    return [
        *base_rules(),
        Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
        Rule("word_length", lambda c: ~c("word_chars").between(2 * c("n_words"), 15 * c("n_words"))),
        Rule("shouting", lambda c: 10 * c("n_upper") > 4 * c("word_chars")),
        Rule("repeated_lines", lambda c: 2 * c("n_dup_lines") > c("n_words")),
        Rule("table_cells", lambda c: 10 * c("n_pipes") > c("n_words")),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, repeats: int = 2, text: str = "text") -> list[dict]:
    """Rules in the order of rejection per cost, each with its cost (seconds over the sample, its statistics included) and selectivity.

    The sample is drawn from all rows, about sample_rows of them, and written once; only sums come to the driver. It
    decides on the order alone, never on a verdict. On an empty sample the given order stays.
    """
    n = docs.count()
    some = materialize(docs.select(text).sample(min(1.0, sample_rows / max(n, 1)), seed=42).repartition(1), "sample")
    rejected = lambda r: verdict_of(text, lambda of: F.coalesce(r.rejects(of), F.lit(False))).cast("int")

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(repeats):
            began = time.perf_counter()
            some.agg(F.sum(column)).first()
            best = min(best, time.perf_counter() - began)
        return best

    flags = some.agg(F.count("*"), *[F.sum(rejected(r)) for r in rules]).first()
    if not flags[0]:
        return [{"rule": r, "cost": 0.0, "rejected": 0.0} for r in rules]
    least = seconds(verdict_of(text, lambda of: F.lit(1)))  # reading, and cutting into words
    found = [{"rule": r, "cost": max(seconds(rejected(r)) - least, 1e-3), "rejected": x / flags[0]} for r, x in zip(rules, flags[1:])]
    return sorted(found, key=lambda x: -x["rejected"] / x["cost"])


def cascade_verdict(rules: list[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """True where no rule rejects; later rules are not evaluated on rows that an earlier one rejected. A null counts as no rejection."""
    verdict = F.lit(True)
    for r in reversed(rules):
        verdict = F.when(F.coalesce(r.rejects(of), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def verdict_of(text: str, f: Callable[[Callable[[str], Column]], Column]) -> Column:
    """f over the statistics of a text column: its words are cut once, its statistics only as f comes to them."""
    cut = _within(_text(text), lambda t: F.struct(t.alias("t"), _words(t).alias("w")))
    return _within(cut, lambda x: f(_statistic(x["t"], x["w"])))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """docs with the statistics, base_failed and kept. rules: over the statistics."""
    ordered = [x["rule"] for x in plan_cascade(docs, rules or production_rules(), sample_rows)]
    failed = F.lit(False)
    for r in base_rules():
        failed = failed | F.coalesce(r.rejects(F.col), F.lit(False))
    return base_statistics(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade_verdict(ordered)))


def kept_only(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """Rows of docs that no rule rejects, with the columns of docs."""
    ordered = [x["rule"] for x in plan_cascade(docs, rules or production_rules(), sample_rows)]
    return docs.where(verdict_of("text", lambda of: cascade_verdict(ordered, of)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *STATISTICS, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return kept_only(docs)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, text, ws, ls, len(ws)::BIGINT AS n,
             [array_to_string(ws[i:i + 7], ' ') FOR i IN range(1, greatest(len(ws) - 6, 1))] AS gs FROM w),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c
      FROM (SELECT doc_id, unnest(gs) AS s, unnest(range(1, len(gs) + 1)) AS i FROM g)),
r AS (SELECT doc_id, sum(least(8, i - p)) AS n_repeat
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS p FROM d WHERE c > 1) GROUP BY doc_id),
s AS (SELECT g.doc_id, n AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
             length(text) - length(replace(text, '|', '')) AS n_pipes
      FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_upper > 4 * word_chars OR 2 * n_dup_lines > n_words OR 10 * n_pipes > n_words) AS kept
FROM b
"""
