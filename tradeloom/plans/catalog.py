"""All registered queries of the market-data library with their SQL oracles."""

from __future__ import annotations

from . import bar_queries, rule_queries, trade_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "bar_queries", "rule_queries", "trade_queries"]
