"""Queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_toxicity", "q_bitslice", "q_repeats", "q_mixing", "q_langid", "q_licenses", "q_htmlcut", "q_simhash", "q_decontam")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"corpusloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(import_module(f"corpusloom.llm.{m}"), "ORACLE_SQL", {}).items()}
