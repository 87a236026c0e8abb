"""Registered queries: each operator applied to the star-schema tables, with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["scalars", "classify", "reports", "questions", "matching", "contracts", "episodes", "signals", "decisions",
           "balance", "sequences", "pages", "batch", "text", "stores", "files", "plans"]


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from saldo.catalog.registry import QUERIES, SQL

    for m in MODULES:
        import_module(f"saldo.catalog.{m}")
    return dict(QUERIES), dict(SQL)
