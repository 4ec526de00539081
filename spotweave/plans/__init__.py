"""Registered queries on the driver tables, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from spotweave.plans.registry import QUERIES, SQL

MODULES = ("prop_queries", "expr_queries", "stat_queries", "io_queries", "file_queries")


def load():
    """(queries, SQL) of all query modules."""
    for name in MODULES:
        import_module(f"spotweave.plans.{name}")
    return QUERIES, SQL
