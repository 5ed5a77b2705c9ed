"""Named queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

#: Modules of this subpackage that register queries.
MODULES: tuple[str, ...] = ("corpus", "evaluation", "relational", "pairs", "style", "files")


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").CATALOG.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").CATALOG.sql.items()}
