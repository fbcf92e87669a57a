"""Registered queries and the composite pipelines."""

from __future__ import annotations


def _load() -> None:
    from lectern.plans import queries  # noqa: F401  registers on import


def all_queries() -> dict:
    from lectern.plans.registry import QUERIES

    _load()
    return QUERIES


def all_oracles() -> dict:
    from lectern.plans.registry import ORACLE

    _load()
    return ORACLE
