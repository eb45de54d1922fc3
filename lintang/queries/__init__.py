"""Registered queries of the core operators and their SQL."""

from lintang.queries import core, reports, reports_sql, sql

FLAGSHIP = "rejection_sampling_stats"
QUERIES = core.QUERIES | reports.QUERIES
ORACLE = sql.ORACLE | reports_sql.ORACLE
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
