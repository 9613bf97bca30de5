"""A corpus pipeline of five stages: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Null texts are empty: the rules reject them, as all texts of fewer than 20 words. Texts are read whole, whatever their
length. Of repeated rows and of copies one row stays, that with the smallest doc_id (a null one only where there is no
other; of equal ids the one with the smallest hash of its text). Extra columns pass through all stages but the last,
whatever their names. An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, packing, rules, secrets, simhash, suffix

STAGES = [
    ("quality_rules", rules.stage),
    ("simhash", simhash.stage),
    ("suffix_dedup", suffix.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: SQL can't express near-duplicates, repeated passages, secrets and packing; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
