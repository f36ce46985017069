"""Query registry: one entry per operator key of the coverage checklist.

Each query is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables
(or views Spark derives from them); ``ORACLES`` holds the matching DuckDB SQL
where the operator is SQL-expressible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierlens.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: bool = True):
    """Register a query; ``oracle`` is DuckDB SQL (prefixed with the derived views)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle) if views else oracle
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from tierlens.plans import (  # noqa: F401
        q_cost, q_routing, q_feedback, q_evaluate, q_sessions, q_context, q_corpus, q_export,
        q_catalog, q_sources, q_streaming, q_user_functions,
    )

    q_streaming._install_twin_oracles()
