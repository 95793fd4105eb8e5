"""Importing this package registers every query."""

from importlib import import_module

MODULES = (
    "retail", "finance", "scoring", "statistics", "evaluation", "operations", "people", "hygiene",
    "search", "streams", "agreement", "roundtrips", "ranking", "sinks",
)

for _name in MODULES:
    import_module(f"scorelake.plans.{_name}")
