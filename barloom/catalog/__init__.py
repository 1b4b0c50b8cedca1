"""Named queries over the supplied tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from barloom.catalog.registry import ORACLES, QUERIES


def load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"barloom.catalog.{name}")


MODULES = ["market", "rolling", "risk", "trend", "jobs", "book", "text", "advice", "live"]
__all__ = ["ORACLES", "QUERIES", "load"]
