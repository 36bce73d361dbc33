"""Registered queries: each key pairs a Spark job over the given tables with
its DuckDB oracle SQL (when one is expressible)."""

from quire.plans.registry import ORACLES, QUERIES, load_all  # noqa: F401
