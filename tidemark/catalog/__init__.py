"""Every operator as a runnable query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from tidemark.catalog.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    import importlib

    for part in PARTS:
        importlib.import_module(f"tidemark.catalog.{part}")
    return QUERIES, ORACLES


PARTS = ("rolling", "rules", "joins", "aggregates", "book", "store", "evaluation", "recursive", "models", "streaming")
