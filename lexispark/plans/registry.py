"""Every query of the core engine with the SQL that DuckDB runs as its check.

Each plan module holds two dictionaries, ``QUERIES`` and ``ORACLE``; this module only
joins them, refusing names that two modules claim.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["text", "packing", "chat", "kernels", "attention", "policy", "evaluation", "configs", "models", "storage", "round_trips"]


def _joined(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lexispark.plans.{name}"), attribute)
        if clash := found.keys() & part.keys():
            raise ValueError(f"{name} registers again: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict:
    return _joined("QUERIES")


def oracle_sql() -> dict:
    return _joined("ORACLE")
