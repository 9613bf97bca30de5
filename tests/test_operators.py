import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from quarry.functions import text as t
from quarry.operators import clean, cluster, encoders, metrics, report, splits, tokens, vectors
from quarry.plans.profiles import PROFILES, Profile, profile
from quarry.plans.runner import Steps
from quarry.sources import records
from quarry.streaming import cleaning


def value(spark, column, **fields):
    return spark.createDataFrame([Row(**fields)], ", ".join(f"{k} string" for k in fields)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("x", "want"), [(None, ""), ("", ""), ("  a \t\n b ", "a b"), ("\xa0", ""), ("a\x1cb", "a b"), (" x　y", "x y")]
)
def test_normalize_space(spark, x, want):
    assert value(spark, t.normalize_space("x"), x=x) == want


def test_text_functions(spark):
    v = lambda c, **f: value(spark, c, **f)
    assert v(t.categories("x"), x=" a.b  c ") == ["a.b", "c"] and v(t.categories("x"), x=None) == []
    assert v(t.primary_category(t.categories("x")), x=None) == ""
    assert v(t.primary_domain("x"), x="cs.LG") == "cs" and v(t.domain_or_unknown("x"), x="") == "unknown"
    assert v(t.strip_latex("x"), x=r"a $x+y$ \begin{eq}b\end{eq} \textbf{bold} {c} $") == "a b c $"
    assert v(t.content_key("a", "b"), a="Héllo_World!", b="X  Y") == "héllo world\nx y"
    assert v(t.plain_title("a"), a="Héllo_World!") == "h llo world"
    assert v(t.word_count("x"), x=None) == 0 and v(t.word_count("x"), x=" a b ") == 2
    assert v(t.submission_year("x"), x="Mon, 2 Apr 2007 19:18:42 GMT") == 2007
    assert v(t.submission_year("x"), x="31 Dec 1999 23:30:00 -0500") == 1999
    assert v(t.submission_year("x"), x="garbage 2004") == 2004 and v(t.submission_year("x"), x=None) is None
    assert v(t.month_key("x"), x="Mon, 2 Apr 2007 19:18:42 GMT") == "2007-04" and v(t.month_key("x"), x="garbage 2004") is None
    assert v(t.dense_clean("x"), x="see https://a.b/c?d now, mail x.y@z.org!") == "see now, mail !"
    assert v(t.clip("x", 8), x="abcdefghij") == "abcde..." and v(t.clip("x", 8), x="abc") == "abc"
    assert v(t.sparse_clean("x"), x="The cat, AND the dogs") == "cat dogs"
    assert v(t.valid_category("x"), x="hep-th") and not v(t.valid_category("x"), x="cs..LG") and not v(t.valid_category("x"), x="a.b.c")
    assert v(t.valid_id("x"), x="0704.0001") and v(t.valid_id("x"), x="hep-th/9901001") and not v(t.valid_id("x"), x=None)
    assert v(t.issue_tags("a", "b"), a="x\ny", b="<p>see www.x.org!!!!") == ["title_newline", "abstract_html", "abstract_url", "abstract_punctuation"]
    assert not v(t.as_bool("x"), x=None) and v(t.as_bool("x"), x="TRUE")


@pytest.mark.parametrize(("n", "word", "want"), [(60, "withdrawn", True), (61, "withdrawn", False), (10, "fine", False)])
def test_placeholder_bound(spark, n, word, want):
    assert value(spark, t.is_placeholder("x"), x=" ".join([word] + ["w"] * (n - 1))) is want


def papers(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "line_no long, id string, title string, abstract string, categories string")


def test_waterfall_order(spark):
    long = " ".join(["word"] * 11)
    rows = [("1", "T", "short", "a"), ("1", "T", long, "a"), ("2", "T", long, "a"), ("3", "t!", long.upper(), "a"), ("4", None, long, "a"), ("5", "U", "withdrawn " * 12, "a"), ("6", "V", " ".join(["x"] * 10), "a")]
    got = {r["line_no"]: r["drop_reason"] for r in clean.judged(papers(spark, rows)).collect()}
    assert [got[k] for k in range(7)] == ["short_abstract", "duplicate_id", "kept", "duplicate_content", "missing_field", "placeholder", "short_abstract"]
    assert sum(r["n"] for r in clean.manifest(papers(spark, rows)).collect()) == 7
    assert clean.manifest(papers(spark, [])).count() == 0


def test_upsert_keeps_the_last(spark):
    held = spark.createDataFrame([(1, "a", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 1, True), (1, "c", 2, True), (2, "d", 1, None)], "k int, v string, o int, extra boolean")
    assert sorted((r["k"], r["v"]) for r in clean.upsert(held, new, ["k"], "o").collect()) == [(1, "c"), (2, "d")]
    assert clean.upsert(held, new.limit(0), ["k"], "o").collect()[0]["v"] == "a"


def quotas_by_hand(counts, target, least, minimum):
    eligible = {c: n for c, n in counts.items() if n >= least}
    if not eligible:
        return {}
    m = max(1, target // len(eligible)) if target < minimum * len(eligible) else minimum
    got = {c: min(m, n) for c, n in eligible.items()}
    left, room = target - sum(got.values()), {c: eligible[c] - got[c] for c in eligible}
    if left <= 0 or not sum(room.values()):
        return got
    raw = {c: left * room[c] / sum(room.values()) for c in eligible}
    got = {c: got[c] + min(room[c], math.floor(raw[c])) for c in got}
    rest = target - sum(got.values())
    for c in sorted(eligible, key=lambda c: (raw[c] % 1, room[c], c), reverse=True):
        if rest > 0 and got[c] < eligible[c]:
            got[c] += 1
            rest -= 1
    return got


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1), st.integers(1, 200), st.integers(1, 8), st.integers(1, 6))
def test_quotas(spark, counts, target, least, minimum):
    df = spark.createDataFrame(list(counts.items()), "category string, n long")
    assert {r["category"]: r["quota"] for r in splits.quotas(df, target, least, minimum).collect()} == quotas_by_hand(counts, target, least, minimum)


def test_split_sizes_and_partitioning(spark):
    sizes = {"a": 3, "b": 4, "c": 5, "d": 10, "e": 15, "f": 45}
    rows = spark.createDataFrame([(f"{c}{k}", c) for c, n in sizes.items() for k in range(n)], "id string, category string")
    one = {r["id"]: r["split"] for r in splits.stratified_split(rows).collect()}
    assert one == {r["id"]: r["split"] for r in splits.stratified_split(rows.repartition(7)).collect()}
    for c, n in sizes.items():
        train, val = max(1, round(n * 0.7)), max(1, round(n * 0.1))
        train -= n - train - val < 1
        assert [sum(s == w and i[0] == c for i, s in one.items()) for w in ("train", "val", "test")] == [train, val, n - train - val]
    assert splits.stratified_sample(rows, 20, 1, 2).count() == 20
    assert splits.drift(splits.random_split(rows)).count() == 18


def test_silhouette_nmi(spark):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(40, 3)), [k % 4 for k in range(38)] + [7, -1]
    points = spark.createDataFrame([(str(k), labels[k], [float(v) for v in x[k]]) for k in range(40)], "id string, label int, embedding array<double>")
    keep = [k for k in range(40) if labels[k] >= 0]
    scores = []
    for i in keep:
        by = {c: [np.linalg.norm(x[i] - x[j]) for j in keep if labels[j] == c and j != i] for c in {labels[j] for j in keep}}
        a, b = by.pop(labels[i]), min(np.mean(v) for v in by.values())
        scores.append((b - np.mean(a)) / max(b, np.mean(a)) if a else 0.0)
    assert metrics.silhouette(points, 3).first()["silhouette"] == pytest.approx(np.mean(scores), abs=1e-9)
    assert metrics.silhouette(points.where("label = 1"), 3).first()["silhouette"] is None
    nmi = lambda pairs: metrics.nmi(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["nmi"]
    assert nmi([(1, 5), (1, 5), (2, 6)]) == pytest.approx(1) and nmi([(1, 1), (1, 1)]) == 1 and nmi([(1, 1), (1, 2)]) == 0


def test_tfidf_rows_have_unit_length(spark):
    docs = spark.createDataFrame([("1", "red cat sleeps red"), ("2", "red dog sleeps"), ("3", None), ("4", "cat dog")], "id string, text string")
    got = tokens.tfidf(docs, min_df=2).collect()
    for k, g in itertools.groupby(sorted(got, key=lambda r: r["id"]), key=lambda r: r["id"]):
        assert sum(r["weight"] ** 2 for r in g) == pytest.approx(1)
    assert {r["id"] for r in got} == {"1", "2", "4"}


def test_svd_projection(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 5))
    long = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(5)], "id long, column long, weight double")
    rows = {r["id"]: r["embedding"] for r in vectors.singular_vectors(long, 3).collect()}
    p = np.array([rows[i] for i in range(12)])
    assert np.linalg.norm(p, axis=0) == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3])


def test_ward_and_density():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, size=(30, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [[[20.0, -20.0]]])
    for labels in (cluster.ward_labels(x[:90], 3), cluster.density_labels(x, 8)):
        groups = [set(labels[k : k + 30]) for k in (0, 30, 60)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and -1 not in set.union(*groups)
    assert cluster.density_labels(x, 8)[90] == -1
    assert cluster.density_labels(x[:1], 8).tolist() == [-1]
    assert cluster.valid_ks([1, 5, 50], 10) == [5] and cluster.valid_ks([50], 10) == [9]
    assert cluster.mode(5) == "full" and cluster.mode(10**6) == "mini_batch" and cluster.proxy_k(50) == 49


def test_encoders(spark):
    docs = spark.createDataFrame([("1", "a  b"), ("2", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in encoders.encode(docs, lambda: lambda xs: [[float(len(x)), 4.0] for x in xs]).collect()}
    assert got["1"] == pytest.approx([0.6, 0.8]) and got["2"] == pytest.approx([0, 1])
    with pytest.raises(KeyError):
        encoders.reduce_vectors(docs, "umap")
    assert encoders.reduce_vectors(docs, "identity").count() == 2


def test_retrieval_by_hand(spark):
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 2), (3, 1, 1)], "label int, rank int, found int")
    support = spark.createDataFrame([(1, 3), (2, 1)], "label int, weight int")
    row = vectors.retrieval_metrics(hits, support, 3, ks=(1, 5)).orderBy("k").collect()
    assert [r["mrr"] for r in row] == pytest.approx([0.25, (1.5 + 1) / 4]) and [r["hit_rate"] for r in row] == pytest.approx([0.25, 1.0])


def test_sources(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "1", "title": "t", "versions": [{"created": "x"}]}\n\n{bad\n{"id": "2", "journal-ref": "j"}\n')
    rows = records.read_json_lines(spark, str(path)).orderBy("_line").collect()
    assert [r["id"] for r in rows] == ["1", None, None, "2"] and [r["_corrupt_record"] is not None for r in rows] == [False, True, True, False]
    with pytest.raises(Exception):
        records.read_json_strict(spark, str(path)).collect()
    df = spark.range(6).withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    records.write_parquet(df, str(tmp_path / "p"), ["split"])
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'train'").count() == 3
    records.write_csv(df, str(tmp_path / "c"))
    assert records.read_csv(spark, str(tmp_path / "c"), "id long, split string").count() == 6
    records.write_json_document(str(tmp_path / "a/b.json"), {"b": 1, "a": 2})
    assert json.loads((tmp_path / "a/b.json").read_text()) == records.read_json_document(str(tmp_path / "a/b.json")) == {"a": 2, "b": 1}
    assert records.read_json_document(str(tmp_path / "none"), 5) == 5
    assert [len(b) for b in records.batches(df, ["id"], 4)] == [4, 2]
    assert {r["field"]: r["n"] for r in records.json_fields(spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":3}',)], "value string")).collect()} == {"a": 2, "b": 1}


def test_profiles():
    with pytest.raises(ValueError):
        Profile("x", train_fraction=0.9)
    assert profile("local", seed=7).key() != PROFILES["local"].key()
    with pytest.raises(KeyError):
        profile("none")
    assert len(PROFILES) == 6


def test_steps_skip_dependents():
    s = Steps()
    assert s.run("a", lambda: 1) == 1 and s.run("a", lambda: 2) == 1
    assert s.run("b", lambda: 1 / 0) is None and s.run("c", lambda: 3, ("b",)) is None
    assert s.failed["c"] == "needs b" and s.failed["b"].startswith("ZeroDivisionError")


def test_report(spark):
    m = spark.createDataFrame([("a", 0.5, None), ("b", 0.5, 0.1), ("c", None, 0.9)], "name string, nmi double, npmi double")
    assert [r["name"] for r in report.sorted_metrics(m).collect()] == ["b", "a", "c"]
    assert report.union_all([m, m.select("name")]).count() == 6


def test_runner(spark, sf_dir, tmp_path):
    from quarry.plans import runner

    small = profile("local", tfidf_rows=120, dense_rows=60, k_grid=(3, 4), min_cluster_sizes=(3,), min_df=2, svd_components=4, max_features=200, silhouette_sample=100)
    two = lambda: lambda xs: [[float(len(x)), 1.0 + x.count("e")] for x in xs]
    steps = runner.run(spark, small, sf_dir, str(tmp_path), {"mpnet": two})
    assert steps.failed["embed bert"].startswith("KeyError") and steps.failed["cluster bert kmeans"] == "needs embed bert"
    wanted = {f"cluster {e} {c}" for e in ("tfidf", "mpnet") for c in ("kmeans", "density", "ward")} | {"retrieval", "report"}
    assert wanted <= set(steps.done), steps.failed
    held = records.read_json_document(f"{tmp_path}/{small.key()}/report.json")
    assert len(held["metrics"]) == 6 and {s["stage_type"] for s in held["stages"]} == {"embedding", "clustering", "retrieval"}
    assert all(m["test_label_count"] >= 1 and m["cluster_to_category_ratio"] > 0 for m in held["metrics"]) and held["findings"]
    assert records.read_json_document(f"{tmp_path}/{small.key()}/report.ipynb")["nbformat"] == 4
    found = report.search_results(spark, f"{tmp_path}/{small.key()}/search/*/*/*.csv", "k int, cost double, silhouette double, best boolean")
    assert {(r["embedding"], r["clustering"]) for r in found.collect()} >= {("tfidf", "kmeans"), ("mpnet", "ward")}


def test_nearest_keeps_repeated_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [9.0, 9.0]), ("b", [5.0, 0.0]), (None, [9.0, 8.0])], "id string, embedding array<double>")
    centers = spark.createDataFrame([(k, [float(k), float(k)]) for k in range(10)], "cluster int, centroid array<double>")
    for block in (5000, 3):
        monkeypatch.setattr(vectors, "BROADCAST_ROWS", block)
        got = sorted((str(r["id"]), r["cluster"], round(r["distance"], 6)) for r in vectors.nearest(rows, centers, "cluster", 2).collect())
        assert got == [("None", 8, 1.0), ("a", 0, 0.0), ("a", 9, 0.0), ("b", 2, round(13**0.5, 6))]
        queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(8)], "q int, vector array<double>")
        hits = vectors.top_k(queries, rows.where("id = 'b' OR id IS NULL").withColumn("id", F.coalesce("id", F.lit("z"))), 1, 2, "q", "id").collect()
        assert {(r["q"], r["id"]) for r in hits} == {(0, "b")} | {(k, "z") for k in range(1, 8)}
    assert [r["cluster"] for r in vectors.nearest(rows, centers.where("cluster < 0"), "cluster", 2).collect()] == [None] * 4


def test_waterfall_of_blank_ids_and_hot_content(spark):
    rows = [("", "t", "a b", "c")] * 90 + [(f"i{k % 40}", "same title", "w " * 12, "c") for k in range(60)] + [("x", None, "w " * 12, "c"), ("y", "other", "w " * 12, "c")]
    got = {r["drop_reason"]: r["n"] for r in clean.manifest(papers(spark, rows)).collect()}
    assert got == {"missing_field": 91, "duplicate_id": 20, "duplicate_content": 39, "kept": 2}


def test_mini_batches_come_near_full_k_means(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (80, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (6, 6, 6))])
    v = spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(x)], "id string, embedding array<double>")
    small, full = (cluster.cost(v, cluster.fit_kmeans(v, 4, how)) for how in ("mini_batch", "full"))
    assert full <= small * (1 + 1e-9) and small < 1.3 * full
    grid = cluster.fit_grid(v, "density", [5, 20]).collect()
    assert [r["clusters"] for r in grid if r["best"]] == [4]


def test_cached_tables_and_models(spark, tmp_path):
    from pyspark.ml.feature import NGram

    made = []
    frame = lambda n: lambda: made.append(n) or spark.createDataFrame([(k, [1.0, 2.0]) for k in range(n)], "id long, embedding array<double>")
    get = lambda n, **k: records.cached(spark, frame(n), str(tmp_path), "sparse", "test", 25, **k).count()
    assert (get(3), get(4), get(4, rows=3), get(4, rows=4), get(5, dim=2), get(5, dim=7)) == (3, 3, 3, 4, 4, 5) and made == [3, 4, 5]
    records.save_model(NGram(n=3), str(tmp_path / "m"))
    assert records.load_model(NGram, str(tmp_path / "m")).getN() == 3
    assert [len(b) for b in records.batches(spark.range(7), ["id"], 3)] == [3, 3, 1]


def test_report_documents(spark):
    m = [{"pipeline": "TFIDF + Kmeans", "nmi": 0.5, "npmi": None, "silhouette": 0.1, "cluster_to_category_ratio": 2.0}, {"pipeline": "B", "nmi": 0.4, "npmi": 0.3, "silhouette": 0.2}]
    said = report.findings(report.profile_summary(profile("whole"), report.split_report(None)), m, [{"pipeline_name": "x", "enabled": True, "success": False}], [{"k": 5, "mrr": 0.2, "hit_rate": 0.6}])
    assert len(said) == 8 and any("TFIDF + Kmeans (nmi 0.5000)" in x for x in said) and any("x." in x for x in said)
    assert report.findings({}, [], [], []) == ["No results."]
    assert report.notebook([("markdown", "# a"), ("code", "1\n2")])["cells"][1]["source"] == ["1\n", "2"]
    held = spark.createDataFrame([("a", 5, 0.3), ("b", 5, 0.1)], "stage string, setting int, score double")
    new = spark.createDataFrame([("a", 5, 0.1), ("a", 9, 0.1)], "stage string, setting int, score double")
    assert [(r["stage"], r["setting"]) for r in report.best_configs(held, new, ["stage"], "score", "setting").orderBy("stage").collect()] == [("a", 5), ("b", 5)]
    assert vectors.backend() == vectors.backend("no_such_library") == "exact"
    assert vectors.backend("json") == "json"
    rows, best = encoders.search_reducers(held.select(F.col("stage").alias("id")), lambda df: df.count() * 1.0, {("half",): lambda df: df.limit(1), ("all",): lambda df: df})
    assert [r["best"] for r in rows] == [False, True] and best.count() == 2


def test_split_ranks_with_many_buckets(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("category"))
    one = {r["id"]: r["rank"] for r in splits.ranked(rows, "category").collect()}
    monkeypatch.setattr(splits, "BUCKET_ROWS", 3)
    assert {r["id"]: r["rank"] for r in splits.ranked(rows, "category").collect()} == one and sorted(one.values()) == list(range(1, 501))


def test_stop_words_are_a_parameter(tmp_path):
    from quarry.functions import stopwords

    (tmp_path / "w").write_text("the\nof\nthe\n")
    assert stopwords.load(str(tmp_path / "w")) == ("of", "the") and stopwords.STOP_WORDS


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024-01-01 00:00:00"), ("1", "2024-01-01 00:10:00"), ("2", "2024-01-01 00:20:00")], "id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = cleaning.write_available(cleaning.first_seen(stream, "id", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_density_labels_every_row_beyond_the_fit(spark, tmp_path, monkeypatch):
    import numpy as np

    from quarry.operators import cluster

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 4)) for c in (0, 5)] + [np.full((1, 4), 50.0)])
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    fitted = cluster.fit_sample(v, "density", 5, rows=60)
    got = [(r["id"], r["cluster"]) for r in cluster.label_all(v, fitted).collect()]
    labels = dict(got)
    assert len(got) == len(labels) == 121
    assert all(labels[r["id"]] == r["cluster"] for r in fitted.collect())
    assert len({labels[k] for k in range(60)} - {-1}) == 1 == len({labels[k] for k in range(60, 120)} - {-1}) and labels[120] == -1
    assert {labels[k] for k in range(60)} & {labels[k] for k in range(60, 120)} <= {-1}
    noise = spark.createDataFrame([(0, -1)], "id long, cluster int")
    assert {r["cluster"] for r in cluster.label_all(v, noise).collect()} == {-1}
