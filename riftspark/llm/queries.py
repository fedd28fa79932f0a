"""The queries of the ten operators and of the pipeline, and their SQL where DuckDB can state it."""

from __future__ import annotations

import importlib

#: Module and function of each query.
_AT = {
    "op1_byte_bpe": "bpe",
    "op2_quality_rules": "quality_rules",
    "op3_mixing": "mixing",
    "op4_url_filter": "url_filter",
    "op5_quality_classifier": "classifier",
    "op6_topk_search": "topk_search",
    "op7_near_dedup": "near_dedup",
    "op8_warc": "warc",
    "op9_lm_score": "lm_score",
    "op10_pii": "pii",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _AT.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _AT.items():
        sql = getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
