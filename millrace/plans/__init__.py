"""Registered queries: every module of this package that has QUERIES adds its queries and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

FLAGSHIP = "p1_d1_w1_a4_meeting_panel"


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE_SQL", {}).items()}
