"""Loads every query module and keeps the list of names each one registers."""

import importlib
import os

from attestry.plans.registry import QUERIES

SUITES: dict[str, list[str]] = {}

for _name in ("text", "units", "entities", "taxonomy", "attributes", "evidence",
              "verify", "describe", "evaluate", "streams", "enrich"):
    if os.path.exists(os.path.join(os.path.dirname(__file__), f"q_{_name}.py")):
        _before = set(QUERIES)
        importlib.import_module(f"attestry.plans.q_{_name}")
        SUITES[_name] = [n for n in QUERIES if n not in _before]
