"""Registered queries: each operator over the given tables, with its oracle SQL."""

from importlib import import_module

MODULES = ("quality", "profile", "drift", "leakage", "risk", "history", "sources")


def load_all() -> None:
    for m in MODULES:
        import_module(f"tabwarden.queries.{m}")
