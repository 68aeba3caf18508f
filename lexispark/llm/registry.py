"""Queries of this subpackage: ``opN_<name>`` over a whole table, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_text", "queries_pages", "queries_chat"]


def _joined(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"lexispark.llm.{name}"), attribute)
    return found


def queries() -> dict:
    return _joined("QUERIES")


def oracle_sql() -> dict:
    return _joined("ORACLE")
