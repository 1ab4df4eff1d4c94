"""Queries and SQL of the text operators."""

from __future__ import annotations

import importlib

MODULES = ("sentences", "lookalikes", "pieces", "encodings", "scans", "tokens", "containers", "cuts")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            out.update(importlib.import_module(f"foliant.llm.{name}").QUERIES)
        except ModuleNotFoundError as e:
            if e.name != f"foliant.llm.{name}":
                raise
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            out.update(getattr(importlib.import_module(f"foliant.llm.{name}"), "ORACLE", {}))
        except ModuleNotFoundError as e:
            if e.name != f"foliant.llm.{name}":
                raise
    return out
