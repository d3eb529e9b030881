"""Collects the ledger queries: name -> (callable, SQL or None)."""

from __future__ import annotations


def _all() -> dict:
    from tallyspark.plans import MODULES

    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
