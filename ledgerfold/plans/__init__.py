"""Query catalogue; importing :func:`load` registers every plan module."""

from importlib import import_module

MODULES = ["returns", "features", "markets", "people", "relational", "modeling", "profiles", "panels", "marts"]


def load():
    """Import all plan modules and return (queries, oracles)."""
    for name in MODULES:
        import_module(f"ledgerfold.plans.{name}")
    from ledgerfold.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
