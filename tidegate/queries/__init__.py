"""Registered queries, grouped by what they show."""
from importlib import import_module

MODULES = ("ingest", "profiling", "detection", "damage", "repairing", "evaluation", "planning", "study", "comparing", "auditing", "scoring", "recommending", "streams", "gating", "fitting")


def load_all() -> None:
    for m in MODULES:
        import_module(f"tidegate.queries.{m}")
