"""Registered queries and their oracle SQL."""

from __future__ import annotations

from loomgraph.plans import tables, trees
from loomgraph.plans.oracle import ORACLE_SQL as TABLES_SQL

#: Each query is the function of its name.
QUERIES = {name: getattr(tables, name) for name in TABLES_SQL} | {name: getattr(trees, name) for name in trees.ORACLE_SQL}
ORACLE_SQL = TABLES_SQL | trees.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
