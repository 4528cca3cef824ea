"""Queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["text", "retrieval", "io", "hot_keys"]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), "SQL", {})
    return out


def flagship(spark, sf_dir: str):
    return import_module(f"{__name__}.retrieval").flagship(spark, sf_dir)
