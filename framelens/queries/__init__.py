"""Registered queries over the given tables, each with its SQL check where one exists."""

from importlib import import_module

MODULES = ("time_order", "distribution", "scoring", "learning", "artifacts")


def registered():
    """All queries and all SQL checks by name."""
    for module in MODULES:
        import_module(f"framelens.queries.{module}")
    from framelens.queries.registry import QUERIES, SQL

    return QUERIES, SQL
