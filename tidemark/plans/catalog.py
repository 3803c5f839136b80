"""Registry of the queries: one callable per operator, with its SQL oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB text with the same result."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places (and turn -0.0 into 0.0) for comparison."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r6(*names: str) -> str:
    """SQL twin of :func:`tidy` for a list of double columns."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)
