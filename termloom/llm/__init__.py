"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["frequency", "neardup", "distinctive", "sentences", "markup", "topn", "encode", "packing", "garbled"]


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
