"""Query catalogue: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomgrid.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` is a DuckDB statement over the driver tables, with the
    model views named in ``views`` prepended as CTEs."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, with_views(sql, *views) if sql is not None else None)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the modules fills REGISTRY
    import importlib
    for m in MODULES:
        importlib.import_module(f"roomgrid.plans.{m}")
    return REGISTRY


MODULES = ["q_search", "q_text", "q_dialogue", "q_history", "q_limits", "q_integrity", "q_load", "q_ingest", "q_stream"]
