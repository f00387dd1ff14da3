"""Queries over the tables, and the SQL they must equal."""

from tidemark.plans import composed, features, indicators, research, statistics  # noqa: F401  they register their queries
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
