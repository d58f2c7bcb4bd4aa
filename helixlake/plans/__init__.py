"""Registered queries of the workbench."""

import importlib

MODULES = ["evolution", "spatial", "omics", "workbench", "literature", "simulation", "records", "lab", "control", "formulas", "agent", "columns", "state", "sessions", "loops", "sources", "proteins", "exchange"]


def load():
    """(queries, oracle SQL) of all plan modules."""
    from helixlake.plans import registry

    for name in MODULES:
        importlib.import_module(f"helixlake.plans.{name}")
    return registry.QUERIES, registry.ORACLE
