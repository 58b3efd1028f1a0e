"""Registered queries: library operators over the driver's tables, with the SQL they must equal."""

import importlib

MODULES = ["capture", "health", "lifecycle", "events", "errors", "evidence", "trees", "audit", "streams", "reports"]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"workloads.{name}")
    return importlib.import_module("workloads.registry")
