"""Connected components of an edge table by alternating star contractions.

Each round replaces every edge by edges to the smallest neighbour (first for
the larger, then for the smaller neighbours of a node). Node minima are
pre-aggregated and joined back with salt, so a hub with a third of all edges
is spread over tasks; each round is stored, so lineage stays short. The number
of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of directed edges (u, v). ``larger``: each node links its
    larger neighbours to the smallest of itself and all its neighbours;
    otherwise each node links itself and its smaller neighbours to the smallest."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if larger:
        both = both.union(both.select(F.col("w").alias("n"), F.col("n").alias("w")))
    else:
        both = both.select(F.greatest("n", "w").alias("n"), F.least("n", "w").alias("w"))
    low = both.groupBy("n").agg(F.min("w").alias("m"))
    if larger:
        low = low.withColumn("m", F.least("n", "m"))
    met = salted_join(both, low, ["n"], F.col("w"), how="inner")
    if larger:
        return met.filter("w > n").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
    linked = met.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (columns u, v; u <> v);
    ``component`` is the smallest node id reachable."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    shape = None
    for _ in range(max_rounds):
        # Every node but a component's smallest has an edge: done when it has exactly one, and no
        # target has an edge of its own. Two rounds that leave count and sum alike show that.
        now = stored(_star(_star(now, larger=True), larger=False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == shape:
            break
        shape = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
