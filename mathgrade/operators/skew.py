"""A join that a hot key doesn't pin to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column | None = None,
                salts: int = 16, how: str = "inner") -> DataFrame:
    """Join ``left`` with a table that is unique on ``keys`` (an aggregate).

    ``right`` is replicated ``salts`` times and each left row picks one replica by a hash of ``spread`` (all its
    columns by default), so a key with a third of all rows is spread over ``salts`` tasks. Null keys meet null keys."""
    pick = F.xxhash64(*([spread] if spread is not None else [F.col(c) for c in left.columns]))
    a = left.withColumn("_salt", F.pmod(pick, F.lit(salts)).cast("int"))
    b = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys],
                     F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_pick"))
    on = [F.col("_salt") == F.col("_pick"), *[F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]]
    return a.join(b, on, how).drop("_salt", "_pick", *[f"_key_{i}" for i in range(len(keys))])
