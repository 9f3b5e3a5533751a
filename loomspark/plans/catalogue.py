"""All queries over the driver tables, with their SQL twins."""

from __future__ import annotations

import importlib

FAMILIES = ("scans", "clicks", "cleaning", "tables", "learning")


def _families():
    return [importlib.import_module(f"loomspark.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {k: f for m in _families() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _families() for k, s in m.SQL.items()}
