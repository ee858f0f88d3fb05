"""Every operator as a query over the benchmark tables, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

_MODULES = ("basics", "joins", "aggregates", "windows", "features", "institutional", "composites", "layers", "series", "streaming")


def _load():
    from tickloom.checks import registry
    for name in _MODULES:
        importlib.import_module(f"tickloom.checks.{name}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().SQL)
