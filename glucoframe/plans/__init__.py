"""Registered queries (Spark) and their DuckDB SQL oracles."""

from glucoframe.plans.registry import QUERIES, ORACLES, load_all  # noqa: F401
