"""Registry of named queries (Spark side) and their DuckDB oracle SQL.

Query modules decorate ``(spark, sf_dir) -> DataFrame`` callables with
``@query(name, sql)``.  A query without SQL is checked rows-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ("q_accounts", "q_calllog", "q_images", "q_metrics", "q_tables", "q_models",
           "q_scraped", "q_streams")

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Doubles leave the engine rounded to 6 places on both sides of the check."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every query module (each registers itself)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def _utc(fn: QueryFn) -> QueryFn:
    """Pin the session time zone: day/hour texts and date parsing are UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    load_all()
    return {k: _utc(v) for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
