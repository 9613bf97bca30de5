"""Queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query -> module; the module has a function of that name, and SQL where there is any.
MODULES = {
    "op1_quality_classifier": "classifier",
    "op2_suffix_dedup": "suffix",
    "op3_simhash": "simhash",
    "op4_quality_rules": "rules",
    "op5_imatch": "imatch",
    "op6_bpe": "bpe",
    "op7_secrets": "secrets",
    "op8_packing": "packing",
    "op9_lm_scores": "lm",
    "op10_token_files": "tokenfile",
}


def _module(name: str):
    return importlib.import_module(f"quarry.llm.{MODULES[name]}")


def queries() -> dict:
    return {k: getattr(_module(k), k) for k in MODULES}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k in MODULES if (sql := getattr(_module(k), "SQL", None))}
