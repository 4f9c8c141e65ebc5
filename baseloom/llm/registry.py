"""Registry of this subpackage's queries, and helpers its operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.session import scratch_path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a (spark, directory) -> DataFrame function, with its SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: later passes and lost executors start from it."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:12]}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it several times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, however often later expressions use it.

    The optimizer copies a projected expression into each filter and lambda that refers to it; it does not
    copy what a generator returns.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
