"""Queries: operators bound to tables, by name."""

import importlib

#: Modules that register queries.
MODULES = ("tiers", "cleaning", "strings", "splitting", "analytics", "fragments", "spectra", "curation", "tasks")


def load():
    """The catalog, with the queries of all modules."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.catalog")
