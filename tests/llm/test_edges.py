"""Nulls, empty and long texts, repeated rows, ties, extra columns and empty tables, for every operator and stage."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from llm_cases import ODD, frame

from quarry.llm import bpe, classifier, imatch, lm, packing, registry, rules, secrets, simhash, suffix, tokenfile

OPERATORS = {
    "classifier": lambda spark, docs: classifier.score(docs, classifier.train(docs, spark.createDataFrame([(6, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int"))),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "rules": lambda spark, docs: rules.quality_rules(docs),
    "imatch": lambda spark, docs: imatch.compare_with_next(docs),
    "bpe": lambda spark, docs: bpe.encode(docs, decode=True),
    "secrets": lambda spark, docs: secrets.find(docs),
    "redact": lambda spark, docs: secrets.redact(docs),
    "lm": lambda spark, docs: lm.score(docs),
    "tokenfile": lambda spark, docs: tokenfile.read_tokens(tokenfile.token_shards(docs)),
    "suffix": lambda spark, docs: suffix.remove_repeats(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_of_odd_tables(spark, odd, name):
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in OPERATORS[name](spark, odd).select("doc_id").collect()) == sorted((k is not None, k or 0) for k, _ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_packing_of_odd_and_empty_tables(spark, odd, empty):
    assert packing.pack(empty).count() == 0
    got = packing.pack(odd).collect()
    assert sum(r["piece"] == 0 for r in got) == len(ODD) and sum(r["doc_id"] is None for r in got) == 3


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_and_empty_tables(spark, odd, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, empty, "").count() == 0
    out = stage(spark, odd, "")
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.schema.simpleString() == odd.schema.simpleString()
        assert all(r["kept"] == "own kept" and r["row"] == "own row" and r["document"] == "own document" for r in out.collect())


def test_simhash_stage_keeps_one_of_a_group(spark, odd):
    kept = [r["doc_id"] for r in simhash.stage(spark, odd, "").collect()]
    assert kept.count(6) == 1 and 7 not in kept and kept.count(None) <= 1 and 1 in kept


LONG = [(1, "stone river light " * 60_000), (2, "z" * 1_000_000), (3, None), (4, "é" * 300_000 + " end"), (4, "é" * 300_000 + " end")]


def written(spark, path, rows):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [ODD, LONG, []], ids=["odd", "long", "empty"])
def test_queries(spark, tmp_path, rows):
    """Every query over nulls, empty and very long texts, repeated rows and clashing columns: a row for each, with the values that plain Python gives."""
    path = written(spark, tmp_path, rows)
    text = [(k, t or "") for k, t in rows]
    told = lambda name, *columns: sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, path).select(*columns).collect())
    want = lambda f: sorted(str((k, *f(t))) for k, t in text)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    words = lambda t: t.encode().split()
    crc = lambda k, n: zlib.crc32(str(k if k is not None else "").encode()) % n
    assert told("op1_quality_classifier", "doc_id", "held_out") == sorted(str((k, crc(k, 5) == 0)) for k, _ in text)
    assert told("op2_suffix_dedup", "doc_id", "n_bytes") == want(lambda t: (len(t.encode()),))
    twice = {t for t in (t for _, t in text) if [x for _, x in text].count(t) > 1}
    got = registry.queries()["op2_suffix_dedup"](spark, path).collect()
    assert all(r["n_removed"] == r["n_bytes"] and r["kept_sha256"] == sha(b"") for r in got if r["n_bytes"] >= 400 and r["n_bytes"] in {len(t.encode()) for t in twice} and r["doc_id"] in (4, 7))
    assert {(r["doc_id"], r["fingerprint"]) for r in registry.queries()["op3_simhash"](spark, path).collect()} == {(k, simhash.fingerprint(t).hex()) for k, t in text}
    assert told("op4_quality_rules", "doc_id", "n_words") == want(lambda t: (len(words(t)),))
    assert told("op5_imatch", "doc_id", "n_chars") == want(lambda t: (len(t),))
    library = bpe.encoder()
    ids = {t: library.encode([t])[0] for _, t in text}
    assert told("op6_bpe", "doc_id", "n_tokens", "decoded_sha256") == want(lambda t: (len(ids[t]) // 4, sha(library.decode(ids[t]).encode())))
    assert told("op7_secrets", "doc_id", "n_assign", "n_access", "n_hex") == want(lambda t: tuple(sum(k == x for _, k, _ in secrets.base_spans(t)) for x in range(3)))
    pieces = registry.queries()["op8_packing"](spark, path).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids[t]) // 4 + 1 for _, t in text) and all(1 <= r["length"] <= 4096 for r in pieces)
    assert told("op9_lm_scores", "doc_id", "n_tokens") == want(lambda t: (len(words(t)) + 1,))
    end = (1).to_bytes(4, "little")
    assert told("op10_token_files", "doc_id", "n_tokens", "ids_crc32") == want(lambda t: (len(ids[t]) // 4 + 1, zlib.crc32(ids[t] + end)))
