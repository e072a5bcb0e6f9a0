"""Imports every module that registers queries."""

from tessera.plans import details, more, positional, ranking, search, sets, statistics, texts  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
