"""All registered queries and their SQL statements."""

from __future__ import annotations

import importlib

from .oracle import compose

MODULES = ["q_areas", "q_register", "q_published", "q_tables", "q_links", "q_valuation", "q_forecast", "q_timeline", "q_map", "q_coverage"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{name}"), attribute))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def statements() -> dict[str, str]:
    return {name: compose(sql) for name, sql in _collect("ORACLE").items()}
