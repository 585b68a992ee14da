"""Aggregation, window, sort and top-k operators.

All group-bys are hash aggregates with map-side partial aggregation. Windows
keyed by a source id (running index, previous-row compare) go through
``ranks`` so a hot source is split across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import ranks
from .skew import salted_join


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of metrics per group."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in metrics])


def rate_with_se(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Mean and count, binomial standard error sqrt(p(1-p)/n) of the rate
    and of the error rate."""
    p = F.avg(F.col(flag).cast("double"))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(p.alias("rate"), n.alias("n")) \
        .withColumn("error_rate", 1 - F.col("rate")) \
        .withColumn("se", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))


def pass_rate_by(df: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    """Pass rate and size per key (e.g. augmentation round)."""
    return df.groupBy(key).agg(F.avg(F.col(passed).cast("double")).alias("pass_rate"),
                               F.count(F.lit(1)).alias("count"))


def counts_side_by_side(df: DataFrame, row_key: str, col_key: str, values: Sequence) -> DataFrame:
    """Counts per (row_key, col_key) pivoted to one column per value (0 if none)."""
    return df.groupBy(row_key).pivot(col_key, list(values)).count().na.fill(0)


def incorrect_rate(df: DataFrame, keys: Sequence[str], flags: str | None = None, n: str = "n", c: str = "c") -> DataFrame:
    """1 - mean over rows of the share of true, from a flag list or from
    counts (``c`` of ``n``); nothing at all -> 0."""
    if flags is not None:
        a = F.col(flags)
        share = F.try_divide(F.size(F.filter(a, lambda x: x)), F.size(a))
    else:
        share = F.try_divide(F.col(c).cast("double"), F.col(n))
    share = F.coalesce(share, F.lit(0.0))
    return df.groupBy(*keys).agg((1 - F.avg(share)).alias("incorrect_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, NULL dropped, largest first."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), F.col(col))


def crosstab_shares(df: DataFrame, row_key: str, col_key: str, values: Sequence) -> DataFrame:
    """Row x category counts plus row-normalised shares (NULL for a row
    with none of the categories)."""
    pv = df.groupBy(row_key).pivot(col_key, list(values)).count().na.fill(0)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return pv.select(row_key, *[F.col(str(v)) for v in values],
                     *[F.try_divide(F.col(str(v)).cast("double"), total).alias(f"share_{v}") for v in values])


def distinct_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """G9."""
    return df.groupBy(*keys).agg(F.countDistinct(col).alias(f"n_distinct_{col}"))


def dataset_summary(df: DataFrame, dataset: str = "dataset", level: str = "level",
                    passed: str = "pass_at_k", novelty: str = "novelty") -> DataFrame:
    """Rows, distinct levels, mean pass (2 decimals) and mean novelty
    (3 decimals) or 'N/A'."""
    return df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(level).alias("levels"),
        F.format_number(F.avg(F.col(passed).cast("double")), 2).alias("mean_pass"),
        F.coalesce(F.format_number(F.avg(F.col(novelty).cast("double")), 3), F.lit("N/A")).alias("mean_novelty"),
    )


def group_summary(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Count, mean, sample std, min, max per group."""
    m = F.col(metric)
    return df.groupBy(key).agg(F.count(m).alias("count"), F.avg(m).alias("mean"),
                               F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, std, min, quartiles, max per numeric column
    (long form: one row per column)."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "x")
    one = x.groupBy("column").agg(F.count("x").alias("count"), F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).alias("nulls"),
                                  F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = ranks.quantiles(x, "x", [0.25, 0.5, 0.75], ["column"]).select("column", F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    return one.join(q, "column", "left").select("column", "count", "nulls", "mean", "std", "min", "p25", "p50", "p75", "max")


def accuracy_and_median(df: DataFrame, correct: str, metric: str) -> DataFrame:
    """Overall accuracy and exact median of a metric, both from stored counts: ``df`` is evaluated once."""
    counts = materialised(df.groupBy(F.col(correct).cast("double").alias("_ok"), F.col(metric).cast("double").alias("_x"))
                          .agg(F.count(F.lit(1)).alias("_n")), "counts")
    median = ranks.quantiles(counts, "_x", [0.5], count="_n").select(F.col("q_0").alias(f"median_{metric}"))
    known = F.when(F.col("_ok").isNotNull(), F.col("_n"))
    one = counts.agg(F.try_divide(F.sum(F.col("_ok") * F.col("_n")), F.sum(known)).alias("accuracy"))
    return one.join(F.broadcast(median), how="left")  # one row each


def counts_two_ways(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Counts by (a, c) and by (b, c) in one pass with grouping sets."""
    return df.groupingSets([[a, c], [b, c]], a, b, c).agg(F.count(F.lit(1)).alias("count"))


def running_index(df: DataFrame, key: str, order: Sequence, name: str = "augmentation_round") -> DataFrame:
    """0-based index within key in ``order`` (skew-safe, see ranks)."""
    return ranks.index_within_group(df, [key], order, name)


def attach_group_size(df: DataFrame, key: str, name: str = "n_augmented") -> DataFrame:
    """Rows per key on every row: an aggregate (partial map-side) joined
    back with salt, so a hot key is spread over tasks."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return salted_join(df, sizes, [key])


def drop_consecutive_repeats(df: DataFrame, key: str, order: Sequence, col: str) -> DataFrame:
    """Drop a row equal to the previous row of the same key. The
    previous row is found by an equi-join on (key, index - 1), whose keys are
    unique, instead of a lag() window over a possibly hot key."""
    idx = ranks.index_within_group(df, [key], order, "_i")
    prev = idx.select(F.col(key).alias("_pk"), (F.col("_i") + 1).alias("_pi"), F.col(col).alias("_prev"))
    j = idx.join(prev, (idx[key].eqNullSafe(prev["_pk"])) & (idx["_i"] == prev["_pi"]), "left")
    keep = F.col("_prev").isNull() | ~F.col(col).eqNullSafe(F.col("_prev"))
    return j.filter(keep).drop("_pk", "_pi", "_prev", "_i")


def best_per_group(df: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """The row with the largest ``score`` per group (max_by with a
    struct score: later fields break ties; a negated candidate number makes
    the first candidate win)."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), score).alias("_b"))
    return agg.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def ranked_list(df: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """All candidates of a group as a list ordered by score descending,
    plus the best. Bounded by the candidates generated per prompt."""
    agg = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(score).alias(score), F.col(item).alias(item))), False)
        .alias("candidates"))
    return agg.withColumn("best", F.element_at("candidates", 1))


def order_by_abs(df: DataFrame, col: str) -> DataFrame:
    """Order by |col| descending, NULLs dropped."""
    return df.filter(F.col(col).isNotNull() & ~F.isnan(col)).orderBy(F.abs(col).desc())


def five_numbers(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Min, quartiles, median and max per group (exact, from value counts)."""
    q = ranks.quantiles(df, metric, [0.0, 0.25, 0.5, 0.75, 1.0], keys)
    return q.select(*keys, *[F.col(f"q_{i}").alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])
