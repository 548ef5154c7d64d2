"""Registered queries over the driver's tables, each with the SQL it must equal."""

from importlib import import_module

AREAS = ("spatial", "catalogue", "scaling", "geometry", "pixels", "summaries", "statistics", "ledger", "sources")


def load_all():
    from checks import registry

    for area in AREAS:
        import_module(f"checks.{area}")
    return registry.QUERIES, registry.ORACLES
