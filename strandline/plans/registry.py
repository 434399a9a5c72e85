"""The queries over the driver's tables, with their SQL."""

from __future__ import annotations

from importlib import import_module

from strandline.plans.cohort import ORACLES, QUERIES

#: Modules that register queries, by subject.
MODULES = ("scalars", "relational", "graph", "clinical", "quality", "loading", "causal", "streams", "questions", "audit", "entities", "profiles", "answers")
for _module in MODULES:
    import_module(f"strandline.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
