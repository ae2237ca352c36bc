"""Registered queries and the multi-step programs."""

from importlib import import_module

MODULES = ["ingest", "describe", "modelling", "evaluation"]


def load_all() -> None:
    """Fill the registry."""
    for name in MODULES:
        import_module(f"loanlife.plans.{name}")
