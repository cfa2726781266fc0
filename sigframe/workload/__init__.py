"""The registered queries."""

from __future__ import annotations

import importlib

MODULES = ["series", "timing", "texts", "maps", "models"]


def load():
    """(queries, sql), after importing every query module."""
    from sigframe.workload import registry

    for m in MODULES:
        importlib.import_module(f"sigframe.workload.{m}")
    return registry.QUERIES, registry.SQL
