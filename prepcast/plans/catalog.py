"""Registry of the deliverable queries: name -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables. Names are the operator IDs of the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from prepcast.plans import q_analysis, q_model, q_ops, q_tables  # noqa: F401
