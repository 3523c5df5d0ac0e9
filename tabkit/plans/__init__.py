"""Compositions of operators: the generation run and the checked queries."""

import importlib

from tabkit.plans.base import QUERIES

for _area in ("profile", "sample", "text", "decode", "generate", "ml", "compare"):
    importlib.import_module(f"tabkit.plans.queries_{_area}")

__all__ = ["QUERIES"]
