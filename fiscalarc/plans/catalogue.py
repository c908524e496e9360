"""Everything that is registered, section by section."""

from __future__ import annotations

import importlib

SECTIONS = ["ingestion", "filtering", "joining", "aggregating", "windowing", "ranking", "sets",
            "scalars", "retrieving", "graphs", "deriving", "streams", "userfunctions"]


def _load():
    for name in SECTIONS:
        importlib.import_module(f"fiscalarc.plans.{name}")
    from . import registry
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return _load().resolved()
