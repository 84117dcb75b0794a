"""All queries of the engine by name, and their oracle SQL."""

from __future__ import annotations

from sparkloom.plans import more_queries, task_queries  # noqa: F401  register their queries
from sparkloom.plans.queries import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "sql_group_having"
