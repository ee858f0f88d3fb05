"""Queries of the operators and their SQL."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_lm_scoring": "lm_scoring", "op2_url_filter": "url_filter", "op3_near_dedup": "near_dedup", "op4_packing": "packing", "op5_line_dedup": "line_dedup", "op6_quality_rules": "quality_rules", "op7_secret_scan": "secrets", "op8_decontamination": "decontamination",
    "op9_quality_classifier": "byte_cnn",
    "op10_substring_dedup": "substring_dedup", "op11_importance_resampling": "resampling", "op12_filter_audit": "filter_audit", "op13_byte_bpe": "byte_bpe",
}


def _modules():
    return {name: importlib.import_module(f"tickloom.llm.{module}") for name, module in _QUERIES.items()}


def queries():
    return {name: getattr(m, name) for name, m in _modules().items()}


def oracle_sql():
    return {name: m.SQL for name, m in _modules().items() if getattr(m, "SQL", None)}
