"""The corpus queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

from gridloom.llm.runtime import ship

_QUERIES = {
    "op1_quality_model": ("quality_model", None),
    "op2_quality_rules": ("quality_rules", None),
    "op3_decontaminate": ("decontaminate", "OP3_SQL"),
    "op4_mix_sources": ("mixing", "OP4_SQL"),
    "op5_token_ids": ("token_ids", None),
    "op6_ngram_score": ("ngram_lm", None),
    "op7_url_rules": ("url_rules", None),
    "op8_minhash_dedup": ("near_dedup", "OP8_SQL"),
    "op9_language_id": ("language_id", None),
    "op10_warc_revisits": ("warc", "OP10_SQL"),
    "op11_pack_sequences": ("packing", None),
    "op12_filter_audit": ("filter_audit", "OP12_SQL"),
    "op13_whiten": ("whitening", None),
}


def _runner(module: str, name: str):
    def run(spark, sf_dir):
        ship(spark)
        return getattr(importlib.import_module(f"gridloom.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _runner(module, name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"gridloom.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
