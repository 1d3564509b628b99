"""Registered queries: every operator applied to the given tables, with its SQL twin."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _module in ("features", "sources", "survey", "splits", "evaluation", "feedback", "promotion", "explanation", "models"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
