"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark.catalog.registry import CALLS, SQL


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")


__all__ = ["CALLS", "SQL", "load"]
