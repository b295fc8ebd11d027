"""All registered queries by name: (query, function that returns its SQL twin or None)."""

from __future__ import annotations

import importlib

_MODULES = ("text_checks", "table_checks", "memory_checks", "file_checks")


def checks() -> dict:
    out = {}
    for name in _MODULES:
        out.update(importlib.import_module(f"checks.{name}").CHECKS)
    return out
