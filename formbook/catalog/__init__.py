"""Registered queries and their SQL checks."""

from __future__ import annotations

import importlib

MODULES = (
    "features", "ranking", "scalars", "joins", "sources", "quality", "analytics", "learning", "serving",
    "racing",
)


def load():
    """(queries, oracles) of every catalog module."""
    from formbook.catalog.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"formbook.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
