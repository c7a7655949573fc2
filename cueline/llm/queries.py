"""Registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name to the module that holds it.
MODULES = {
    "op1_quality": "quality",
    "op2_minhash": "minhash",
    "op3_chat": "chat",
    "op4_sharding": "sharding",
    "op5_secrets": "secrets",
    "op6_mixing": "mixing",
    "op7_lines": "lines",
    "op8_decontamination": "decontamination",
    "op9_neighbours": "neighbours",
    "op10_html": "html",
    "op11_tokens": "tokens",
    "op12_codes": "codes",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"cueline.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"cueline.llm.{module}") for name, module in MODULES.items()}
    return {name: module.ORACLE_SQL for name, module in modules.items() if getattr(module, "ORACLE_SQL", None)}
