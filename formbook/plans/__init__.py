"""Registered queries, grouped as in the blueprint."""

from importlib import import_module

MODULES = ["scalars", "projections", "windows", "quotes", "joins", "aggregates", "resampling", "pricing", "sources", "studies", "calibration", "streams", "learning"]


def load():
    """(queries, sql) after importing every plan module."""
    from formbook.plans import registry

    for name in MODULES:
        import_module(f"formbook.plans.{name}")
    return registry.QUERIES, registry.ORACLES
