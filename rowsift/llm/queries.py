"""Queries of the pipeline operators, with SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_NAMES = [
    "html.op1_html_extraction",
    "decontaminate.op2_decontamination",
    "wavelet.op3_token_shards",
    "secrets.op4_secret_scan",
    "simhash.op5_simhash_dedup",
    "mixing.op6_source_mixing",
    "quality.op7_quality_rules",
    "sharding.op8_sharding",
    "suffix.op9_suffix_dedup",
    "fpindex.op10_substring_dedup",
]


def queries() -> dict:
    out = {}
    for name in _NAMES:
        module, _, function = name.partition(".")
        out[function] = getattr(import_module(f"rowsift.llm.{module}"), function)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _NAMES:
        module, _, function = name.partition(".")
        sql = getattr(import_module(f"rowsift.llm.{module}"), "ORACLE", None)
        if sql:
            out[function] = sql
    return out
