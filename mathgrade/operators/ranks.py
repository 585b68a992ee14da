"""Distributed positions, ranks and exact quantiles (hard part H1).

A window without ``partitionBy`` (or partitioned by a hot key) runs in one
task. Instead rows fall into buckets of the order (group, order columns), a
number of them that follows from the number of rows, so that a bucket holds
about ``ROWS_PER_BUCKET`` rows however large the table is. Every (group,
bucket) computes a local running sum, a small table of per-(group, bucket)
totals gives its offset, and a join adds it back. The totals have at most
(#groups + #buckets) rows, and a hot group is spread over as many tasks as it
has buckets.

Bucket edges come from a sample of ``PER_EDGE`` rows an edge. Up to ``FANOUT``
buckets are found by a search over literal edges. More make a tree of two
levels: the literal edges lead to one of ``FANOUT`` ranges, and each range has
a sorted array of its own edges, which Spark computes from a stored sample and
broadcasts (at most ``FANOUT`` squared edges, of ``EDGE_CHARS`` characters a
string). Edges are fixed before they are used, so a recomputed task finds the
same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised

#: Rows of a bucket, about; fewer if that gives work to all shuffle partitions.
ROWS_PER_BUCKET, LEAST_ROWS = 250_000, 20_000
#: Ranges of a level of the tree, sampled rows per edge, characters of a string in an edge.
FANOUT, PER_EDGE, EDGE_CHARS = 512, 20, 64


def n_buckets(rows: int, shuffle_partitions: int, rows_per_bucket: int = ROWS_PER_BUCKET, fanout: int = FANOUT) -> int:
    """Buckets for a table: by its rows, and beyond the two levels of the tree no more of them."""
    spread = min(shuffle_partitions, math.ceil(rows / min(LEAST_ROWS, rows_per_bucket)))
    return max(1, min(fanout * fanout, max(math.ceil(rows / rows_per_bucket), spread)))


def _search(key: Column, edges: list[Column]) -> Column:
    """Number of edges that are not above ``key``: a binary search over literals."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < edges[mid], search(lo, mid)).otherwise(search(mid + 1, hi))
    return search(0, len(edges)).cast("long")


def _search_array(key: Column, edges: Column, most: int) -> Column:
    """The same over a sorted array of at most ``most`` edges, by halving."""
    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(key < F.get(edges, mid), left).otherwise(right))
    begin = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(edges), F.lit(0)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    return F.aggregate(steps, begin, half, lambda s: s["lo"]).cast("long")


def _literal_edges(sample: DataFrame, cols: Sequence[str], buckets: int) -> list[Column]:
    rows = sample.orderBy(*cols).collect()
    types = [sample.schema[c].dataType for c in cols]
    picks = sorted({len(rows) * i // buckets for i in range(1, buckets)}) if rows else []
    return [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(rows[i], types, cols, strict=True)]) for i in picks]


def bucketed(df: DataFrame, cols: Sequence[str], edges_from: DataFrame | None = None, rows: int | None = None,
             rows_per_bucket: int = ROWS_PER_BUCKET, fanout: int = FANOUT) -> DataFrame:
    """``df`` with its bucket ``_b`` (long) in the order of ``cols``. ``rows`` is the number of rows, if known;
    ``edges_from`` is a small sample made by the caller."""
    cols, spark = list(cols), df.sparkSession
    clip = lambda c, t: F.substring(c, 1, EDGE_CHARS).alias(c) if isinstance(t, T.StringType) else F.col(c)
    source = df if edges_from is None else edges_from
    narrow = source.select(*[clip(c, source.schema[c].dataType) for c in cols])
    rows = narrow.count() if rows is None else rows
    buckets = n_buckets(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), rows_per_bucket, fanout)
    if buckets == 1:
        return df.withColumn("_b", F.lit(0).cast("long"))
    key = F.struct(*[F.col(c) for c in cols])
    sample = narrow.sample(min(1.0, PER_EDGE * buckets / rows), seed=7) if edges_from is None else narrow
    if buckets <= fanout:
        return df.withColumn("_b", _search(key, _literal_edges(sample, cols, buckets)))
    sample = materialised(sample, "edge-sample")
    top = _literal_edges(sample.sample(min(1.0, fanout / buckets), seed=8), cols, fanout)
    width = math.ceil(buckets / (len(top) + 1))
    taken = sample.withColumn("_b1", _search(key, top)).groupBy("_b1").agg(F.array_sort(F.collect_set(key)).alias("_s"))
    pick = lambda i: F.get("_s", F.floor(F.size("_s") * i / width).cast("int"))
    fine = materialised(taken.select("_b1", F.transform(F.sequence(F.lit(1), F.lit(max(1, width - 1))), pick).alias("_edges")), "edges")
    met = df.withColumn("_b1", _search(key, top)).join(F.broadcast(fine), "_b1", "left")
    return met.withColumn("_b", F.col("_b1") * (width + 1) + _search_array(key, F.col("_edges"), width)).drop("_b1", "_edges")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                weight: Column | None = None, inclusive: bool = True, edges_from: DataFrame | None = None, rows: int | None = None,
                rows_per_bucket: int = ROWS_PER_BUCKET, fanout: int = FANOUT) -> DataFrame:
    """Running sum of ``weight`` (default 1) within ``keys`` in ascending
    ``order`` (column names). With weight 1 and ``inclusive`` this is
    row_number(); ``order`` should be unique within a group for a
    deterministic result. ``edges_from`` (a small table of the same keys and
    order to take the bucket edges from) and ``rows`` are as in ``bucketed``."""
    keys, order = list(keys), list(order)
    w = F.lit(1).cast("bigint") if weight is None else weight
    r = bucketed(df, [*keys, *order], edges_from, rows, rows_per_bucket, fanout).withColumn("_w", w)
    totals = r.groupBy(*keys, "_b").agg(F.sum("_w").alias("_tot"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0))).drop("_tot")
    totals = totals.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), "_off")
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_loc", F.sum("_w").over(local))
    on = [F.col("_b") == F.col("_b2"), *[F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]]
    value = F.col("_off") + F.col("_loc")
    if not inclusive:
        value = value - F.col("_w")
    return r.join(totals, on).withColumn(name, value) \
        .drop("_b", "_b2", "_w", "_loc", "_off", *[f"_k_{i}" for i in range(len(keys))])


def global_index(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Position of each row in ``order`` (unique), starting at ``start``."""
    out = running_sum(df, [], order, "_rn")
    return out.withColumn(name, F.col("_rn") - 1 + F.lit(start)).drop("_rn")


def index_within_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based position within each group."""
    out = running_sum(df, keys, order, "_rn")
    return out.withColumn(name, F.col("_rn") - 1).drop("_rn")


def average_ranks(df: DataFrame, value: str, group: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Average (1-based, ties averaged) rank of each distinct ``value`` within
    ``group``. Input rows may be raw or pre-aggregated with a ``count``
    column. Output: group, value, cnt, avg_rank."""
    cnt = F.sum(count) if count else F.count(F.lit(1))
    vc = df.groupBy(*group, value).agg(cnt.cast("bigint").alias("cnt"))
    cum = running_sum(vc, list(group), [value], "_cum", weight=F.col("cnt"))
    return cum.withColumn("avg_rank", F.col("_cum") - (F.col("cnt") - 1) / 2.0).drop("_cum")


def quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: keys, n, q_0, q_1, ... Input rows may be raw or counts (``count``).

    Rows become counts per distinct value; the two ranks around each quantile are picked from their running sum by
    conditional minima. No group's values are held in one buffer. Nulls are left out."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")) \
        .agg((F.sum(count) if count else F.count(F.lit(1))).alias("_c"))
    cum = running_sum(counts, keys, ["_v"], "_cum", weight=F.col("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    if keys:
        on = [F.col(k).eqNullSafe(F.col(f"_n_{i}")) for i, k in enumerate(keys)]
        cum = cum.join(sizes.select(*[F.col(k).alias(f"_n_{i}") for i, k in enumerate(keys)], "n"), on)
    else:
        cum = cum.crossJoin(F.broadcast(sizes))  # one row
    aggs = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        aggs += [F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo_{i}"),
                 F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi_{i}")]
    out = cum.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return out.select(*keys, "n", *[(F.col(f"_lo_{i}") + (F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1)))
                                     * (F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))).alias(f"q_{i}") for i, q in enumerate(qs)])
