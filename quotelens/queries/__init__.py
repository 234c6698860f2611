"""Queries on the given test tables, each with SQL that must give the same rows."""

from quotelens.queries.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
