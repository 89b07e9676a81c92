"""Registered queries over the driver's tables."""

from gradeframe.catalog import (  # noqa: F401
    array_queries, choice_queries, math_queries, sql_queries, table_queries,
)
from gradeframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
