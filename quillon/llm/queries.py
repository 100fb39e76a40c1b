"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import importlib


def _made() -> list[tuple[str, str, str, str | None]]:
    """(query, module, function, name of its SQL)."""
    return [
        ("op1_quality", "quality", "op1_quality", None),
        ("op2_rules", "rules", "op2_rules", None),
        ("op3_scoring", "scoring", "op3_scoring", None),
        ("op4_bpe", "bpe", "op4_bpe", None),
        ("op5_simhash", "simhash", "op5_simhash", None),
        ("op6_packing", "packing", "op6_packing", None),
        ("op7_mixing", "mixing", "op7_mixing", None),
        ("op8_warc", "warc", "op8_warc", "OP8_SQL"),
        ("op9_html", "html", "op9_html", "OP9_SQL"),
        ("op10_ann", "ann", "op10_ann", None),
    ]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"quillon.llm.{module}"), function) for name, module, function, _ in _made()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"quillon.llm.{module}"), sql) for name, module, _, sql in _made() if sql}
