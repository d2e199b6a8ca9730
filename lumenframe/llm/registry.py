"""Query modules of this subpackage."""

from importlib import import_module

NAMES = ["runs", "boilerplate", "tokens", "mixing", "truncation", "personal", "scans", "neardup"]


def modules() -> list:
    return [import_module(f"lumenframe.llm.{name}_queries") for name in NAMES]
