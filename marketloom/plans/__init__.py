"""Registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("bars", "technical", "joins", "ranges", "bitemporal", "shaping", "tables", "quality",
            "streams", "live_state", "evidence", "surface")


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"marketloom.plans.{name}")


def queries():
    from marketloom.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql():
    from marketloom.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
