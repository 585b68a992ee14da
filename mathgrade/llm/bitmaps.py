"""Bit maps of hashed keys with a fixed number of bits, for semi-joins that need no shuffle of their larger side.

A map says "no" only for keys that were not put in, so a row that fails it can go; a row that passes may still be
foreign, and what follows must decide exactly. The size does not grow with the data: a full map lets all rows pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a map in Spark (``bitmap_construct_agg`` has this fixed width).
ROW_BITS = 1 << 15


def bit_rows(places: DataFrame, column: str) -> DataFrame:
    """(row, bits): the map of the places (longs from 0) in ``column``."""
    return places.filter(F.col(column).isNotNull()).groupBy((F.col(column) / ROW_BITS).cast("long").alias("row")) \
        .agg(F.bitmap_construct_agg(F.col(column) % ROW_BITS).alias("bits"))


def collected(places: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """The map as bytes on the driver: ``n_bits`` / 8 of them, whatever the number of places."""
    out = np.zeros(n_bits // 8, np.uint8)
    for row in bit_rows(places, column).toLocalIterator():
        at = row["row"] * (ROW_BITS // 8)
        out[at:at + ROW_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places (unsigned) are in the map."""
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marked(df: DataFrame, rows: DataFrame, place: Column, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``place`` is in the map (as ``bit_rows``, which is broadcast)."""
    held = df.withColumn("_place", place % ROW_BITS).withColumn("_map", (place / ROW_BITS).cast("long"))
    met = held.join(F.broadcast(rows.select(F.col("row").alias("_map"), F.col("bits").alias("_bits"))), "_map", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_place", "_map", "_bits")
