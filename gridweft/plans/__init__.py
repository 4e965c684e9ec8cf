"""Registered queries over the driver's tables."""

from gridweft.plans import clocks, connectivity, crossings, hierarchy, metrics, phases, style  # noqa: F401
from gridweft.plans.registry import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
