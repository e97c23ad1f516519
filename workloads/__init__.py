"""Queries over the given tables, and the SQL they are checked against."""

from importlib import import_module

MODULES = ("research", "decisions", "models", "live", "rules")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
