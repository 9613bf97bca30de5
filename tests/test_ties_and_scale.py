"""Ties that an order leaves open, and steps whose work must not grow faster than their input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import assert_same
from quarry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def lineitem(spark, folder, files):
    """A folder with lineitem of one Parquet file for each list of (l_orderkey, l_linenumber, l_partkey, l_suppkey), and its DuckDB twin."""
    con = duckdb.connect()
    (folder / "lineitem.parquet").mkdir()
    for k, rows in enumerate(files):
        values = ", ".join(str(tuple(r)).replace("None", "NULL") for r in rows)
        con.sql(f"COPY (SELECT a::BIGINT AS l_orderkey, b::INTEGER AS l_linenumber, c::BIGINT AS l_partkey, e::BIGINT AS l_suppkey FROM (VALUES {values}) AS t(a, b, c, e)) TO '{folder}/lineitem.parquet/part-{k}.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


def test_first_by_id_takes_the_first_row_of_a_tie(spark, tmp_path):
    files = [[(k % 50, 1 + k // 250, (k * 37 + f) % 101, 1) for k in range(500)] for f in (1, 0)] + [[(90, None, 1, 1), (90, 2, 2, 1), (91, None, 3, 1), (None, 1, 8, 1), (None, 1, 4, 1)]]
    con = lineitem(spark, tmp_path, files)
    assert_same(spark, con, str(tmp_path), QUERIES["d1_first_by_id"], SQL["d1_first_by_id"])


def jobs(spark, run):
    """Jobs that run starts."""
    spark.sparkContext.setJobGroup(run.__name__, "")
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(run.__name__))


def test_singular_vectors_take_one_pass(spark):
    import numpy as np

    from quarry.operators import vectors

    x = np.random.default_rng(3).normal(size=(300, 120)) * (np.random.default_rng(4).random((300, 120)) < 0.3) * np.linspace(1, 3, 120)
    long = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, column long, weight double")
    got = {}

    def projection():
        got.update((r["id"], r["embedding"]) for r in vectors.singular_vectors(long, 6).collect())

    assert jobs(spark, projection) < 25
    p, (u, s, _) = np.array([got[i] for i in range(300)]), np.linalg.svd(x, full_matrices=False)
    assert np.abs(p) == pytest.approx(np.abs(u[:, :6] * s[:6]), abs=1e-8)


def test_tfidf_of_an_id_that_occurs_again(spark):
    from quarry.operators import tokens

    rows = [("1", "red cat red"), ("2", "cat $x red$ dog"), ("1", "red dog"), (None, "dog"), (None, r"\emph{cat} dog"), ("4", None)]
    got = {(r["id"], r["term"]): r["weight"] for r in tokens.tfidf(spark.createDataFrame(rows, "id string, text string"), min_df=1).collect()}
    assert set(got) == {("1", "red"), ("1", "cat"), ("1", "dog"), ("2", "cat"), ("2", "dog"), (None, "dog")}
    assert got[("1", "red")] > got[("1", "cat")] and got[(None, "dog")] == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_suppliers_are_made_within_their_order(spark, tmp_path, monkeypatch):
    from quarry.plans import model_queries

    con = lineitem(spark, tmp_path, [[(k % 40, 1, 1, (k * k) % 17) for k in range(300)], [(7, 1, 1, None), (None, 1, 1, 2), (None, 1, 1, 3), (99, 1, 1, 5), (99, 1, 1, 5)], [(500, 1, 1, k) for k in range(150)]])
    assert "Join" not in plan(QUERIES["h13_pair_cooccurrence"](spark, str(tmp_path)))
    for rows in (500_000, 20):
        monkeypatch.setattr(model_queries, "PAIR_ROWS", rows)
        assert_same(spark, con, str(tmp_path), QUERIES["h13_pair_cooccurrence"], SQL["h13_pair_cooccurrence"])


def test_content_tokens_are_read_off_the_plain_ones(spark):
    from quarry.functions import text as t
    from quarry.functions.stopwords import STOP_WORDS
    from quarry.operators import tokens

    rows = spark.createDataFrame([("The KKelvin, the-dog", "A_b 'x' $5.0\n\tthe"), (None, "..."), ("", None)], "title string, abstract string")
    counts = tokens.token_counts(rows)
    assert plan(counts).count("regexp_replace") == 1  # text is cleaned once for both plain and content
    source = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    want = {}
    for k, f in (("raw", t.raw_tokens), ("plain", t.plain_tokens), ("content", t.content_tokens)):
        for r in rows.select(F.explode(f(source)).alias("w")).collect():
            want[k, r["w"]] = want.get((k, r["w"]), 0) + 1
    assert {(r["configuration"], r["token"]): r["n"] for r in counts.collect()} == want and ("content", "the") not in want and "the" in STOP_WORDS


def test_coherence_does_not_exchange_documents(spark):
    from quarry.operators import metrics

    rows = [(str(k), f"c{k % 3}", f"w{k % 5} w{k % 7} shared w{k % 2}") for k in range(60)] + [("60", None, "shared w1"), ("61", "small", "w1 w2")]
    found = metrics.coherence(spark.createDataFrame(rows, "id string, label string, text string"), top=4)
    assert "collect_list" not in plan(found)
    words = {i: set(text.split()) for i, _, text in rows}
    n, df, want = len(rows), {}, {}
    for w in words.values():
        for x in w:
            df[x] = df.get(x, 0) + 1
    import math
    from collections import Counter
    from itertools import combinations

    total = Counter(x for _, _, text in rows for x in text.split())
    assert all(df[x] >= 2 for x in total)
    for c in ("c0", "c1", "c2"):
        count = Counter(x for _, label, text in rows if label == c for x in text.split())
        best, scores = sorted(count, key=lambda x: (-count[x], x))[:4], []
        for a, b in combinations(best, 2):
            co = sum(a in w and b in w for w in words.values())
            if 0 < co < n:
                scores.append(math.log((co / n) / (df[a] / n * df[b] / n)) / -math.log(co / n))
        want[c] = sum(scores) / len(scores)
    assert {r["label"]: r["npmi"] for r in found.collect()} == pytest.approx(want)


def test_grid_of_clusters_assigns_the_drawn_rows_alone(spark, monkeypatch):
    import numpy as np

    from quarry.operators import cluster, metrics

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 9)])
    v = spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(x)], "id string, embedding array<double>")
    want = []
    for setting in (5, 20, 500):
        fitted = cluster.fit_sample(v, "density", setting, 80)
        near = cluster.extend(v, fitted).select("id", F.col("cluster").alias("label"))
        want.append((setting, fitted.where("cluster >= 0").select("cluster").distinct().count(), metrics.silhouette(v.join(near, "id"), 3, 50).first()["silhouette"]))
    monkeypatch.setattr(cluster, "extend", None)  # assigns every row
    got = [(r["setting"], r["clusters"], r["silhouette"]) for r in cluster.fit_grid(v, "density", [5, 20, 500], 50, rows=80).collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and got[2][2] is want[2][2] is None
    assert [g[2] for g in got[:2]] == pytest.approx([w[2] for w in want[:2]], abs=1e-9)
