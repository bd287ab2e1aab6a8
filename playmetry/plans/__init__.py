"""Bindings of the provided tables to the game schema, and the registered queries."""

from playmetry.plans import queries_events, queries_players, queries_rules, queries_tables  # noqa: F401
from playmetry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
