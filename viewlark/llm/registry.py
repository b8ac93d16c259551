"""The queries of this subpackage and the DuckDB SQL that yields the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "op1_token_counts",
    "op2_language_id",
    "op3_toxicity",
    "op4_mixing",
    "op5_chat",
    "op6_quality",
    "op7_near_dedup",
    "op8_decontamination",
    "op9_fingerprints",
    "op10_licenses",
)


def queries() -> dict:
    import corpus_pipeline

    found = {name: import_module(f"viewlark.llm.{name}").query for name in _MODULES}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    modules = ((name, import_module(f"viewlark.llm.{name}")) for name in _MODULES)
    return {name: m.ORACLE_SQL for name, m in modules if m.ORACLE_SQL}
