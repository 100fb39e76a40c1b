"""Every registered query of the retrieval engine and its SQL oracle."""

from __future__ import annotations

import importlib

_MODULES = ("text", "retrieval", "extraction", "chat", "stored")


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in _MODULES:
        out |= importlib.import_module(f"quillon.queries.{m}").QUERIES
    return out


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
