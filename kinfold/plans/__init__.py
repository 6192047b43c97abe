"""Bindings of the operators to the given tables."""

from importlib import import_module

MODULES = ["sources", "projections", "filters", "joins", "aggregates", "windows", "sets", "analogs"]


def load():
    """(queries, SQL checks) of every module."""
    for name in MODULES:
        import_module(f"kinfold.plans.{name}")
    from kinfold.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
