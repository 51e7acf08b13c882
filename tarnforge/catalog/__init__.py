"""Registered queries with their oracle SQL."""

from tarnforge.catalog import analytics, evaluation, models, relational, sources, tables, wide  # noqa: F401  they register themselves
from tarnforge.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
