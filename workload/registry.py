"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, directory) -> DataFrame function with its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles at six places, so that both engines print the same value."""
    chosen = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if n in chosen else F.col(f"`{n}`") for n in df.columns])
