"""Every operator as a query on the given tables, with the SQL that must agree."""

from . import cleaning, loading, reports, statistics, views  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
