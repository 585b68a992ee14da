"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the oracle text (omitted for operators SQL cannot express)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c, name: str | None = None) -> Column:
    """Round a double to 6 places so both engines hash the same value."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or (c if isinstance(c, str) else None)) if (name or isinstance(c, str)) else col


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column of a result."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])
