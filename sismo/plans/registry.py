"""Query registry: key -> (Spark query, DuckDB oracle SQL or None).

Every query reads the driver's tables under ``sf_dir`` (or data Spark
derives from them) and runs over whole tables. Computed columns carry the
same alias on both sides; doubles whose last bits depend on summation order
go through ``r6``/``R6``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for mod in ("q_core", "q_explore", "q_series", "q_learn", "q_io"):
        importlib.import_module(f"{__package__}.{mod}")
