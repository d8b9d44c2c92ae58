"""Runnable queries. Importing the package fills the registry."""

from slotwise.plans import files, learning, relational, station, tabular  # noqa: F401
from slotwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
