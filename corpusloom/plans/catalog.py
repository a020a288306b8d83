"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("evaluation", "documents", "annotations", "flows")


def _modules() -> list:
    return [import_module(f"corpusloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
