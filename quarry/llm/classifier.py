"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are DataFrame expressions. On a bounded sample of labelled rows (SAMPLE, the documented bound),
shallow trees are grown over bootstrap samples; each path from a root is a conjunctive rule. A logistic regression
with an L1 penalty keeps few of them, and those are compiled into one column expression that scores every row in the
scan, without Python.

Training rows are those with crc32(doc_id as text) mod 5 other than 0; the labels' rows with null quality are left out.
No statistic uses labels, lang, source or doc_id. Null texts are empty, and all statistics of an empty text are 0.
Without labels of both kinds the score is the share of label 1 (one half without labels). Repeated rows are scored one
by one; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import SPACE, documents, id_remainder

SAMPLE, THRESHOLD = 20_000, 0.3
STATISTICS = ("n_words", "word_length", "symbols", "uppers", "pipes", "marks", "digits", "distinct", "repeats", "lines", "line_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id with STATISTICS (double)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    wide = docs.select("doc_id", t.alias("_t"), F.filter(F.split(t, SPACE, -1), lambda w: w != "").alias("_w"))
    size = F.char_length("_t")
    n = F.size("_w")
    per = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    less = lambda chars: size - F.char_length(F.regexp_replace("_t", chars, ""))
    same = F.transform(F.array("_w"), lambda ws: F.size(F.filter(ws, lambda w, k: F.when(k > 0, w == F.get(ws, k - 1)).otherwise(F.lit(False)))))[0]
    counted = wide.select(
        "doc_id", n.alias("n"), size.alias("size"), F.char_length(F.array_join("_w", "")).alias("chars"), less(r"[#*$%&<>]+").alias("sym"), less("[A-Z]+").alias("upp"), less("[|]+").alias("pip"),
        less("[.,;:!?]+").alias("mar"), less("[0-9]+").alias("dig"), F.size(F.array_distinct("_w")).alias("dis"), same.alias("rep"), (size - F.char_length(F.replace(F.col("_t"), F.lit("\n"), F.lit("")))).alias("nl"),
    )
    c = F.col
    return counted.select(
        "doc_id", c("n").cast("double").alias("n_words"), per(c("chars"), c("n")).alias("word_length"), per(c("sym"), c("chars")).alias("symbols"), per(c("upp"), c("chars")).alias("uppers"), per(c("pip"), c("n")).alias("pipes"),
        per(c("mar"), c("n")).alias("marks"), per(c("dig"), c("chars")).alias("digits"), per(c("dis"), c("n")).alias("distinct"), per(c("rep"), c("n")).alias("repeats"), c("nl").cast("double").alias("lines"),
        per(c("n"), c("nl") + 1).alias("line_words"),
    )


@dataclass(frozen=True)
class PathRule:
    """All conditions (statistic, whether above, threshold) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.conditions:
            out &= (x[:, k] > t) if above else (x[:, k] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.conditions:
            out = out & ((F.col(STATISTICS[k]) > t) if above else (F.col(STATISTICS[k]) <= t))
        return out


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, trees: int = 40, depth: int = 3, bins: int = 24) -> list[PathRule]:
    """Rules of all nodes below the roots of trees over bootstrap samples and random halves of the statistics."""
    found: dict[PathRule, None] = {}
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            found[PathRule(tuple(sorted(path)))] = None
        p = y[rows].mean() if len(rows) else 0
        if not left or len(rows) < 20 or p in (0, 1):
            return
        best = (1e-9, None, None)
        for k in rng.choice(x.shape[1], max(1, (x.shape[1] + 1) // 2), replace=False):
            if not len(cuts[k]):
                continue
            at = np.searchsorted(cuts[k], x[rows, k], "left")  # bin j: above j thresholds
            n = np.cumsum(np.bincount(at, minlength=len(cuts[k]) + 1))[:-1]
            s = np.cumsum(np.bincount(at, weights=y[rows], minlength=len(cuts[k]) + 1))[:-1]
            m, r = len(rows) - n, y[rows].sum() - s
            ok = (n >= 5) & (m >= 5)
            gini = lambda a, b: 2 * a * (1 - a / np.maximum(b, 1))
            gain = np.where(ok, 2 * len(rows) * p * (1 - p) - gini(s, n) - gini(r, m), 0)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], int(k), float(cuts[k][j]))
        if best[1] is None:
            return
        _, k, t = best
        over = x[rows, k] > t
        grow(rows[~over], (*path, (k, False, t)), left - 1)
        grow(rows[over], (*path, (k, True, t)), left - 1)

    for _ in range(trees):
        grow(rng.integers(0, len(x), len(x)), (), depth)
    return list(found)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept: accelerated proximal gradient on the mean logistic loss plus penalty times the weights' sizes."""
    n, m = r.shape
    w, b, z, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    step = 4 * n / (np.linalg.norm(np.column_stack((r, np.ones(n))), 2) ** 2)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(r @ z + c, -30, 30))) - y
        u = z - step * (r.T @ g) / n
        new, shift = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - step * g.mean()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / grown * (new - w), shift + (t - 1) / grown * (shift - b)
        w, b, t = new, shift, grown
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[PathRule]
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        """Score between 0 and 1, over STATISTICS."""
        total = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights):
            total = total + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleEnsemble:
    """The penalty is the strongest whose loss on a fifth of the rows is within 2 % of the best."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleEnsemble([], np.zeros(0), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    rules = tree_paths(x, y, rng)
    r = np.column_stack([q.holds(x) for q in rules]).astype(float) if rules else np.zeros((len(x), 0))
    some = np.flatnonzero((r.mean(axis=0) > 0.002) & (r.mean(axis=0) < 0.998))
    _, first = np.unique(r[:, some], axis=1, return_index=True)  # rules that hold for the same rows are one rule
    some = some[np.sort(first)]
    r, rules = r[:, some], [rules[k] for k in some]
    test = rng.random(len(y)) < 0.2
    losses = []
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        w, b = lasso_logistic(r[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[test] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        losses.append((float(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))) if test.any() else 0.0, penalty))
    best = min(losses)[0]
    w, b = lasso_logistic(r, y, next(penalty for loss, penalty in losses if loss <= 1.02 * best + 1e-9))
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[k] for k in kept], w[kept], b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """labels: doc_id, quality. About `sample` labelled training rows at most, chosen by a hash of the id."""
    usable = labels.where((id_remainder("doc_id", 5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # its size has the bound of the sample
    quality = rows.select(F.col("doc_id"), "text", "quality")
    held = statistics(quality.select(F.struct("doc_id", "quality").alias("doc_id"), "text")).select(F.col("doc_id.quality").alias("quality"), *STATISTICS).toPandas()
    return fit(held[list(STATISTICS)].to_numpy(float), held["quality"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    scored = statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))
