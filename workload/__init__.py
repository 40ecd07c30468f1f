"""Registered queries: one per operator, over the given tables, each with comparison SQL."""

from . import catalog, checks, cleaning, governance, profile, sources  # noqa: F401 - registration
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
