"""Statistics (X1-X23): correlations, ranks, tests, bins, bootstrap.

Correlations are computed from co-moments (``covar_samp``/``var_samp``, merged
pairwise by Spark) so a constant or all-NULL metric gives NULL instead of the
ANSI divide-by-zero that ``corr`` raises (X4). Spearman uses distributed
average ranks (``ranks.average_ranks``). p-values need the t distribution,
which Spark SQL lacks: they are computed on the already-aggregated rows by a
small vectorised continued fraction in a pandas UDF (H2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import all_tasks, materialised
from . import ranks
from .skew import salted_join


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# X1, X4, X5 Pearson
# --------------------------------------------------------------------------

def pearson_expr(x, y) -> Column:
    """Pearson r as an aggregate expression; NULL for a constant side or n < 2."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    return F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))


def correlation_table(df: DataFrame, metrics: Sequence[str], target: str, skip_with_nulls: bool = False) -> DataFrame:
    """One row per metric: n, pearson (NULL for a constant or all-NULL
    metric). ``skip_with_nulls`` drops metrics that contain any NULL (X5)."""
    aggs = []
    for m in metrics:
        aggs.append(F.struct(F.lit(m).alias("metric"),
                             F.count(F.when(F.col(m).isNotNull() & F.col(target).isNotNull(), 1)).alias("n"),
                             F.sum(F.when(F.col(m).isNull(), 1).otherwise(0)).alias("nulls"),
                             pearson_expr(F.when(F.col(target).isNotNull(), F.col(m)),
                                          F.when(F.col(m).isNotNull(), F.col(target))).alias("pearson")).alias(m))
    out = df.agg(*aggs).select(F.explode(F.array(*[F.col(m) for m in metrics])).alias("s")).select("s.*")
    if skip_with_nulls:
        out = out.filter(F.col("nulls") == 0)
    return out


# --------------------------------------------------------------------------
# X2 Spearman via distributed average ranks
# --------------------------------------------------------------------------

def _long_counts(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(metric, x, kept columns) of all non-null values, in one narrow table."""
    wide = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keep), list(metrics), "metric", "x").filter(F.col("x").isNotNull())


def _binary_rho(agg: DataFrame) -> Column:
    """Spearman of a 0/1 label from rank moments: (mean rank of the positives
    - (N + 1) / 2) * sqrt(N1 / N0) / population sd of the ranks."""
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    var_r = F.col("sum_r2") / n - F.pow(F.col("sum_r") / n, 2)
    rho = F.try_divide((F.try_divide(F.col("sum_r_pos"), n1) - (n + 1) / 2) * F.sqrt(F.try_divide(n1, n0)), F.sqrt(var_r))
    return F.when((n1 > 0) & (n0 > 0) & (var_r > 0), rho)


def _rank_moments(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, n1 and rank moments per key from distinct scores with ``cnt`` and ``pos``."""
    rk = ranks.running_sum(scores, [keys[0]], ["score"], "_cum", weight=F.col("cnt"))
    rk = rk.withColumn("r", F.col("_cum") - (F.col("cnt") - 1) / 2.0)
    return rk.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("pos") * F.col("r")).alias("sum_r_pos"),
        F.sum(F.col("cnt") * F.col("r") * F.col("r")).alias("sum_r2"), F.sum(F.col("cnt") * F.col("r")).alias("sum_r"))


def spearman_binary(df: DataFrame, metrics: Sequence[str], label: str) -> DataFrame:
    """X2 for a 0/1 label: all metrics in one rank job. Rows shrink to counts
    per (metric, value) first; rho is a closed form of the rank moments, so
    ranks are never joined back to rows."""
    x = _long_counts(df.filter(F.col(label).isNotNull()), metrics, [label])
    scores = x.groupBy("metric", F.col("x").alias("score")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    agg = _rank_moments(scores, ["metric"])
    return agg.select("metric", "n", _binary_rho(agg).alias("spearman"))


def spearman_table(df: DataFrame, metrics: Sequence[str], target: str) -> DataFrame:
    """Spearman rho of each metric with any target (average ranks over the
    rows where both are present), all metrics in one job: counts per (metric,
    x, y), two rank tables, weighted moments."""
    x = _long_counts(df.select(*metrics, F.col(target).cast("double").alias("y")).filter("y is not null"), metrics, ["y"])
    pairs = x.groupBy("metric", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    for c in ("x", "y"):
        r = ranks.average_ranks(pairs, c, ["metric"], "w").select("metric", c, F.col("avg_rank").alias(f"r{c}"))
        pairs = salted_join(pairs, r, ["metric", c])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    m = pairs.groupBy("metric").agg(F.sum("w").alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * ry).alias("sxy"),
                                    F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return m.select("metric", "n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("spearman"))


def correlation_matrix(df: DataFrame, metrics: Sequence[str], id_col: str) -> DataFrame:
    """metric_a, metric_b, pearson, spearman for each pair, over rows in
    which all metrics are present (``id_col`` unique). Ranks of all metrics
    come from one rank job, joined back by value with salt."""
    full = df.select(id_col, *metrics).dropna(subset=list(metrics))
    x = _long_counts(full, metrics, [id_col])
    r = ranks.average_ranks(x, "x", ["metric"]).select("metric", "x", "avg_rank")
    ranked = salted_join(x, r, ["metric", "x"], F.col(id_col)).groupBy(id_col).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("x"))).alias(m) for m in metrics],
        *[F.max(F.when(F.col("metric") == m, F.col("avg_rank"))).alias(f"r_{m}") for m in metrics])
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1:]]
    one = ranked.agg(*[pearson_expr(p + a, p + b).alias(f"{p}{i}") for i, (a, b) in enumerate(pairs) for p in ("", "r_")])
    rows = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(str(i)).alias("pearson"), F.col(f"r_{i}").alias("spearman"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("s")).select("s.*")


# --------------------------------------------------------------------------
# X3 / X9 p-values (t distribution) on aggregated rows
# --------------------------------------------------------------------------

def _betacf(a, b, x, iters=300, eps=1e-15):
    """Continued fraction for the regularised incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        de = d * c
        h *= de
        if np.all(np.abs(de - 1.0) < eps):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), vectorised."""
    from math import lgamma
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    lg = np.vectorize(lgamma)
    out = np.full(np.broadcast(a, b, x).shape, np.nan)
    a, b, x = np.broadcast_arrays(a, b, x)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    with np.errstate(all="ignore"):
        bt = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.where(x > 0, x, 1)) + b * np.log(np.where(x < 1, 1 - x, 1)))
        bt = np.where((x == 0) | (x == 1), 0.0, bt)
        direct = x < (a + 1) / (a + b + 2)
        f1 = bt * _betacf(a, b, np.where(ok, x, 0.5)) / a
        f2 = 1.0 - bt * _betacf(b, a, np.where(ok, 1 - x, 0.5)) / b
    res = np.where(direct, f1, f2)
    res = np.where(x == 0, 0.0, np.where(x == 1, 1.0, res))
    out[ok] = res[ok]
    return out


def t_two_sided_p(t, df):
    """Two-sided p of Student's t: I_{df/(df+t^2)}(df/2, 1/2)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(all="ignore"):
        x = df / (df + t * t)
    p = betainc(df / 2.0, 0.5, x)
    return np.where(np.isfinite(t) & (df > 0), p, np.nan)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Arrow-batched p-value of t with dof degrees of freedom."""
    tv = t.astype("float64").to_numpy()
    dv = dof.astype("float64").to_numpy()
    return pd.Series(t_two_sided_p(tv, dv))


def corr_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation via t = r sqrt((n-2)/(1-r^2)), df = n - 2."""
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(r.isNotNull() & (n > 2), t_pvalue(t, (n - 2).cast("double")))


def welch_test(df: DataFrame, group: str, metric: str, a_value=1, b_value=0) -> DataFrame:
    """Welch's t-test between two groups; one aggregate, then formula."""
    g = F.col(group)
    x = F.col(metric).cast("double")
    agg = df.agg(
        F.count(F.when(g == a_value, x)).alias("n1"), F.avg(F.when(g == a_value, x)).alias("m1"),
        F.var_samp(F.when(g == a_value, x)).alias("v1"),
        F.count(F.when(g == b_value, x)).alias("n2"), F.avg(F.when(g == b_value, x)).alias("m2"),
        F.var_samp(F.when(g == b_value, x)).alias("v2"))
    se2 = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.pow(F.col("v1") / F.col("n1"), 2) / (F.col("n1") - 1)
                       + F.pow(F.col("v2") / F.col("n2"), 2) / (F.col("n2") - 1))
    out = agg.withColumn("t", t).withColumn("dof", dof)
    return out.withColumn("p_value", F.when(F.col("t").isNotNull() & F.col("dof").isNotNull(),
                                            t_pvalue(F.col("t"), F.col("dof"))))


# --------------------------------------------------------------------------
# X7 length-normalisation sweep (binary label, closed form per alpha)
# --------------------------------------------------------------------------

#: Triples of a score range of an alpha, about, and sampled triples per edge of such a range.
SWEEP_ROWS, SWEEP_PER_EDGE = 250_000, 20


def alpha_grid(lo: float = -1.0, hi: float = 2.0, n: int = 301) -> list[float]:
    return [lo + i * (hi - lo) / (n - 1) for i in range(n)]


def alpha_sweep(df: DataFrame, logp_sum: str, n_tokens: str, label: str,
                alphas: Sequence[float] | None = None) -> DataFrame:
    """For each alpha, Spearman rho between score = logp_sum / n^alpha
    and a 0/1 label. Rows are first reduced to distinct (logp_sum, n)
    with counts; each is scored at all alphas. Scores are dealt in blocks by
    alpha AND score range (edges from a sample), so no alpha lands in one task,
    and each range is sorted alone. With its ranks counted from the range's
    start it is five sums, which the totals of the ranges below turn into
    moments of the ranks. With a binary label, rho is the point-biserial
    correlation of the ranks: (mean rank of positives - (N+1)/2) *
    sqrt(N1 / N0) / sd_pop(ranks), sd_pop from the rank moments."""
    alphas, spark = list(alphas or alpha_grid()), df.sparkSession
    trip = df.filter(F.col(logp_sum).isNotNull() & F.col(n_tokens).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(logp_sum, n_tokens).agg(F.count(F.lit(1)).alias("cnt"),
                                         F.sum(F.col(label).cast("bigint")).alias("pos"))
    trip = materialised(trip, "triples")
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    scores = F.transform(grid, lambda a: F.try_divide(F.col(logp_sum), F.pow(F.col(n_tokens).cast("double"), a)))
    ranges = math.ceil(trip.count() / SWEEP_ROWS)
    edges: dict[int, np.ndarray] = {}
    if ranges > 1:
        few = trip.orderBy(F.rand(7)).limit(SWEEP_PER_EDGE * ranges).select(F.posexplode(scores).alias("k", "s"))
        taken = few.filter("s is not null").groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("_s"))
        picks = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("_s", F.floor(F.size("_s") * i / ranges).cast("int")))
        edges = {r["k"]: np.unique(r["e"]) for r in taken.select("k", picks.alias("e")).collect()}  # some numbers per alpha
    blocks = trip.repartition(all_tasks(spark)).select(scores.alias("scores"), "cnt", "pos") \
        .mapInArrow(_score_blocks(len(alphas), edges), _BLOCKS)
    parts = blocks.groupBy("alpha_idx", "part").applyInArrow(_range_sums, _RANGES)
    below = Window.partitionBy("alpha_idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    off = F.coalesce(F.sum("n").over(below), F.lit(0)).cast("double")
    parts = parts.withColumn("off", off)
    o, n = F.col("off"), F.col("n")
    agg = parts.groupBy("alpha_idx").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("l_pos") + o * F.col("n1")).alias("sum_r_pos"),
        F.sum(F.col("l2") + 2 * o * F.col("l") + o * o * n).alias("sum_r2"), F.sum(F.col("l") + o * n).alias("sum_r"))
    return agg.select("alpha_idx", F.get(grid, F.col("alpha_idx")).alias("alpha"), "n", _binary_rho(agg).alias("spearman"))


_BLOCKS = "alpha_idx int, part int, score array<double>, cnt array<long>, pos array<long>"
_RANGES = "alpha_idx int, part int, n long, n1 long, l_pos double, l double, l2 double"


def _distinct(score: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct scores in order, and the sums of the weights of each."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    new = np.ones(len(score), dtype=bool)
    new[1:] = (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
    at = np.flatnonzero(new)
    return score[at], *[np.add.reduceat(w[order], at) for w in weights]


def _score_blocks(n_alphas: int, edges: dict[int, np.ndarray]):
    """Rows with their scores at all alphas as blocks of distinct scores per alpha and score range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("scores").flatten()
            valid = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n_alphas)
            table = flat.fill_null(0.0).to_numpy().reshape(-1, n_alphas)
            cnt, pos = batch.column("cnt").to_numpy(), batch.column("pos").to_numpy()
            for k in range(n_alphas):
                has = valid[:, k]
                if not has.any():
                    continue
                s, c, p = _distinct(table[has, k], cnt[has], pos[has])
                part = np.searchsorted(edges.get(k, np.zeros(0)), s, side="right")
                at = np.flatnonzero(np.diff(part, prepend=-1))
                off = pa.array([*at, len(s)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(at), pa.int32()), pa.array(part[at], pa.int32()),
                     *[pa.ListArray.from_arrays(off, pa.array(v)) for v in (s, c, p)]], ["alpha_idx", "part", "score", "cnt", "pos"])
    return run


def _range_sums(blocks: pa.Table) -> pa.Table:
    """Sums over the ranks within one score range of an alpha."""
    _, cnt, pos = _distinct(*[np.concatenate([c.flatten().to_numpy() for c in blocks.column(n).chunks]) for n in ("score", "cnt", "pos")])
    rank = np.cumsum(cnt) - (cnt - 1) / 2.0
    sums = [cnt.sum(), pos.sum(), (pos * rank).sum(), (cnt * rank).sum(), (cnt * rank * rank).sum()]
    return pa.table([blocks.column(n).slice(0, 1) for n in ("alpha_idx", "part")] + [pa.array([v]) for v in sums],
                    ["alpha_idx", "part", "n", "n1", "l_pos", "l", "l2"])


def correlations_at_alpha(df: DataFrame, logp_sum: str, n_tokens: str, label: str, alpha: float) -> DataFrame:
    """Pearson and Spearman of logp_sum / n^alpha with a 0/1 label, each with its p-value."""
    x = df.withColumn("_score", F.try_divide(F.col(logp_sum), F.pow(F.col(n_tokens).cast("double"), F.lit(float(alpha)))))
    p = correlation_table(x, ["_score"], label).select("metric", "n", "pearson")
    s = spearman_binary(x, ["_score"], label).select("metric", "spearman")
    out = p.join(F.broadcast(s), "metric")  # one row each
    return out.select(F.lit(float(alpha)).alias("alpha"), "n", "pearson", corr_pvalue(F.col("pearson"), F.col("n")).alias("pearson_p"),
                      "spearman", corr_pvalue(F.col("spearman"), F.col("n")).alias("spearman_p"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    """Alpha with the largest |rho|; the earliest alpha wins ties."""
    return sweep.filter(F.col("spearman").isNotNull()).agg(
        F.max_by(F.struct("alpha", "spearman"), F.struct(F.abs("spearman"), -F.col("alpha_idx"))).alias("b")
    ).select("b.alpha", "b.spearman")


# --------------------------------------------------------------------------
# X10, X11, X13-X19 bins and curves
# --------------------------------------------------------------------------

def standardise(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """(x - mean) / population std, via a broadcast one-row aggregate."""
    st = df.agg(F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    return df.crossJoin(F.broadcast(st)).withColumn(
        name or f"{col}_z", F.try_divide(F.col(col) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def accuracy_coverage(df: DataFrame, score: str, correct: str, n_thresholds: int = 100) -> DataFrame:
    """X11: thresholds t_i = min + i (max - min) / (T - 1); coverage = share of
    rows with score > t_i, accuracy = mean correctness of those (NULL when
    none). Each row adds to the thresholds below it through a bucket number
    j = #thresholds < score, so the work is one aggregate plus T rows."""
    d = df.filter(F.col(score).isNotNull())
    st = d.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    T1 = n_thresholds - 1

    def thr(i):
        return F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / F.lit(T1)
    x = F.col(score)
    j0 = F.when(F.col("_hi") > F.col("_lo"),
                F.ceil((x - F.col("_lo")) * F.lit(T1) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0))
    j0 = F.least(F.greatest(j0, F.lit(0)), F.lit(n_thresholds))
    # exact fix-up against the same threshold expression: j = #{i: t_i < score}
    j1 = F.when((j0 > 0) & (thr(j0 - 1) >= x), j0 - 1).otherwise(j0)
    j = F.when((j1 < n_thresholds) & (thr(j1) < x), j1 + 1).otherwise(j1)
    b = d.crossJoin(F.broadcast(st)).withColumn("_j", j.cast("int")) \
        .groupBy("_j").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(correct).cast("int")).alias("pos"))
    grid = d.sparkSession.range(n_thresholds).select(F.col("id").cast("int").alias("idx"))
    g = grid.crossJoin(F.broadcast(st))
    # rows above threshold i are those with bucket j > i; b has at most T + 1 rows
    jb = g.join(F.broadcast(b), F.col("_j") > F.col("idx"), "left").groupBy("idx", "_lo", "_hi", "_n").agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("covered"), F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"))
    return jb.select("idx", thr(F.col("idx")).alias("threshold"), F.try_divide(F.col("covered").cast("double"), F.col("_n")).alias("coverage"),
                     F.try_divide(F.col("pos").cast("double"), F.col("covered")).alias("accuracy"))


def histogram(df: DataFrame, col: str, label: str | None = None, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max (max in the last bin), count
    and density normalised per label."""
    d = df.filter(F.col(col).isNotNull())
    st = d.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(w > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / w), F.lit(bins - 1))).otherwise(F.lit(0))
    keys = [label] if label else []
    x = d.crossJoin(F.broadcast(st)).withColumn("bin", b.cast("int"))
    c = x.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    tot = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tot")) if keys else None
    if tot is not None:
        c = c.join(tot, keys)
    else:
        c = c.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("_tot"))))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return c.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "count",
                    F.try_divide(F.col("count").cast("double"), F.col("_tot") * width).alias("density"))


def bins_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts on a bins x bins grid between the min and max of x and y, which are stored: they are read twice."""
    df = materialised(df.select(x, y), "points")
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    st = d.agg(F.min(x).alias("_xl"), F.max(x).alias("_xh"), F.min(y).alias("_yl"), F.max(y).alias("_yh"))

    def b(c, lo, hi):
        w = (F.col(hi) - F.col(lo)) / F.lit(bins)
        return F.when(w > 0, F.least(F.floor((F.col(c) - F.col(lo)) / w), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return d.crossJoin(F.broadcast(st)).select(b(x, "_xl", "_xh").alias("x_bin"), b(y, "_yl", "_yh").alias("y_bin")) \
        .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def hexagons(df: DataFrame, x: str, y: str, nx: int = 20, ny: int | None = None) -> DataFrame:
    """X15 as drawn: counts on a grid of hexagons, nx of them across and ny
    (nx / sqrt 3) up between the extremes of x and y: (lattice, x_bin, y_bin,
    x_centre, y_centre, count).

    The centres are two interleaved lattices of rectangles, one at whole and
    one at half steps; a point is rounded to the nearest centre of each and
    belongs to the nearer one, in steps in which the hexagons are regular. x and y are stored: they are read twice."""
    ny = max(1, int(nx / math.sqrt(3))) if ny is None else ny
    df = materialised(df.select(x, y), "points")
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    st = d.agg(F.min(x).alias("_xl"), F.max(x).alias("_xh"), F.min(y).alias("_yl"), F.max(y).alias("_yh"))
    d = d.crossJoin(F.broadcast(st))  # one row

    def steps(c: str, lo: str, hi: str, n: int) -> Column:
        span = (F.col(hi) - F.col(lo)) / F.lit(float(n))
        return F.when(span > 0, (F.col(c) - F.col(lo)) / span).otherwise(F.lit(0.0))

    d = d.select("_xl", "_xh", "_yl", "_yh", steps(x, "_xl", "_xh", nx).alias("_u"), steps(y, "_yl", "_yh", ny).alias("_v"))
    u, v = F.col("_u"), F.col("_v")
    whole = (F.floor(u + 0.5), F.floor(v + 0.5))
    half = (F.floor(u), F.floor(v))
    far_whole = F.pow(u - whole[0], 2) + 3 * F.pow(v - whole[1], 2)
    far_half = F.pow(u - half[0] - 0.5, 2) + 3 * F.pow(v - half[1] - 0.5, 2)
    near = far_whole < far_half
    d = d.select("_xl", "_xh", "_yl", "_yh", F.when(near, 0).otherwise(1).alias("lattice"),
                 F.when(near, whole[0]).otherwise(half[0]).cast("int").alias("x_bin"), F.when(near, whole[1]).otherwise(half[1]).cast("int").alias("y_bin"))
    out = d.groupBy("lattice", "x_bin", "y_bin", "_xl", "_xh", "_yl", "_yh").agg(F.count(F.lit(1)).alias("count"))
    centre = lambda b, lo, hi, n: F.col(lo) + (F.col(b) + F.col("lattice") * 0.5) * (F.col(hi) - F.col(lo)) / F.lit(float(n))
    return out.select("lattice", "x_bin", "y_bin", centre("x_bin", "_xl", "_xh", nx).alias("x_centre"),
                      centre("y_bin", "_yl", "_yh", ny).alias("y_centre"), "count")


def equal_width_right_closed(df: DataFrame, col: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Pandas-cut style: edges linspace(min, max, bins+1), intervals
    right-closed, lowest edge widened by 0.1% of the range."""
    st = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(w > 0, F.greatest(F.least(F.ceil((F.col(col) - F.col("_lo")) / w) - 1, F.lit(bins - 1)), F.lit(0))) \
        .otherwise(F.lit(0))
    return df.crossJoin(F.broadcast(st)).withColumn(name, F.when(F.col(col).isNotNull(), b.cast("int"))) \
        .drop("_lo", "_hi")


def fixed_edges(col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets (e0, e1], (e1, e2], ...; last open above."""
    c = _col(col)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    out = out.when(c > edges[-1], F.lit(labels[-1])) if len(labels) == len(edges) else out
    return out


def trend(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Linear trend of y on x per group."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                                 F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


# --------------------------------------------------------------------------
# X12 Poisson bootstrap, X14 binned KDE, X20 logistic, X21 local linear
# --------------------------------------------------------------------------

#: A prime below 2^31, modulus of the counter-based draws; units of a count drawn one by one; places per replicate.
DRAW_PRIME, DRAW_UNITS = 2_147_483_647, 16
#: Largest Poisson(1) weight that is told apart (a larger one has a chance of 1e-12).
DRAW_MOST = 14


def poisson_edges() -> list[int]:
    """Draws below DRAW_PRIME at which a Poisson(1) variable passes 1, 2, ..."""
    below, term, out = 0.0, math.exp(-1), []
    for k in range(1, DRAW_MOST + 1):
        below += term
        out.append(math.ceil(below * DRAW_PRIME))
        term /= k
    return out


#: Weights (values times replicates) that a task draws at a time, groups whose sums it holds.
DRAW_BLOCK, DRAW_GROUPS = 1 << 19, 64


def _draw(at: np.ndarray, words: Sequence[np.ndarray]) -> np.ndarray:
    """Draws from 0 to DRAW_PRIME - 1 for places ``at``: a polynomial in the place with three random coefficients."""
    h = words[0][:, None] % DRAW_PRIME
    for w in words[1:]:
        h = (h * (at % DRAW_PRIME) + w[:, None]) % DRAW_PRIME  # below 2^63
    return h


def _weights(counts: np.ndarray, words: Sequence[np.ndarray], replicates: int) -> np.ndarray:
    """Poisson(count) weights, a row per value and a column per replicate."""
    at = np.arange(replicates, dtype=np.int64) * DRAW_UNITS + 1
    edges, out = np.array(poisson_edges()), np.zeros((len(counts), replicates))
    few = counts <= DRAW_UNITS
    for i in range(min(DRAW_UNITS, int(counts[few].max(initial=0)))):
        rows = np.flatnonzero(few & (counts > i))
        out[rows] += np.searchsorted(edges, _draw(at + i, [w[rows] for w in words]), side="right")
    if not few.all():
        c, w = counts[~few].astype(float)[:, None], [w[~few] for w in words]
        u1, u2 = ((_draw(at + i, w) + 0.5) / DRAW_PRIME for i in (0, 1))
        normal = np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2)
        out[~few] = np.maximum(0.0, np.floor(c + np.sqrt(c) * normal + 0.5))
    return out


def _replicate_sums(replicates: int):
    """Of (group, value, count, words) rows: each group's sums of weights and weighted values per replicate."""
    step = max(1, DRAW_BLOCK // replicates)

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for g, (swx, sw) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * replicates, pa.string()), pa.array(np.arange(replicates, dtype=np.int32)),
                                              pa.array(swx), pa.array(sw)], ["_g", "rep", "swx", "sw"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            groups = batch.column("_g").dictionary_encode()
            codes = groups.indices.to_numpy()
            x, c, *words = (batch.column(n).to_numpy() for n in ("_x", "_c", "_w0", "_w1", "_w2"))
            for k, g in enumerate(groups.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == k)
                if g not in held and len(held) == DRAW_GROUPS:
                    yield from rows(held)
                swx, sw = held.setdefault(g, (np.zeros(replicates), np.zeros(replicates)))
                for start in range(0, len(mine), step):
                    at = mine[start:start + step]
                    w = _weights(c[at], [v[at] for v in words], replicates)
                    swx += (w * x[at][:, None]).sum(axis=0)
                    sw += w.sum(axis=0)
        yield from rows(held)
    return run


def bootstrap_mean_ci(df: DataFrame, keys: Sequence[str], value: str, replicates: int = 10000,
                      seed: int = 42, level: float = 0.95) -> DataFrame:
    """Basic bootstrap CI of the mean per group (2 mean - quantiles).

    Rows shrink to counts per (group, value). In each replicate a value seen c
    times weighs Poisson(c): a sum of c Poisson(1) draws up to ``DRAW_UNITS``,
    a rounded normal draw beyond. Draws are counter-based: three words of the
    md5 of (seed, group, value) are the coefficients of a polynomial whose
    value at the replicate's place is the draw, so they depend neither on
    partitions nor on retries, independent between values and three-wise
    independent between replicates. The counts are dealt over all tasks, which
    draw blocks of values times replicates and pass on sums per (group,
    replicate). Replicates
    without any draw are left out; a group with none at all has a NULL
    interval. Approximate by design (H3)."""
    keys, b = list(keys), int(replicates)
    d = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    counts = d.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    group = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    text = F.concat_ws("|", F.lit(str(seed)), group, F.round(F.col("_x") * 1_000_000).cast("decimal(38,0)").cast("string"))
    words = [F.conv(F.substring("_m", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_w{i}") for i in range(3)]
    seeded = counts.select(group.alias("_g"), "_x", "_c", F.md5(text.cast("binary")).alias("_m")).select("_g", "_x", "_c", *words)
    drawn = seeded.repartition(all_tasks(df.sparkSession)).mapInArrow(_replicate_sums(b), "_g string, rep int, swx double, sw double")
    sums = drawn.groupBy("_g", "rep").agg(F.sum("swx").alias("swx"), F.sum("sw").alias("sw"))
    reps = sums.select("_g", "rep", F.try_divide("swx", "sw").alias("m"))
    lo_q, hi_q = (1 - level) / 2, 1 - (1 - level) / 2
    # at most ``replicates`` values per group
    qs = reps.groupBy("_g").agg(F.percentile("m", F.lit(lo_q)).alias("q_lo"), F.percentile("m", F.lit(hi_q)).alias("q_hi"))
    means = d.groupBy(*keys).agg(F.avg("_x").alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("_g", group)
    return means.join(qs, "_g", "left").select(*keys, "n", "mean", (2 * F.col("mean") - F.col("q_hi")).alias("ci_low"),
                                               (2 * F.col("mean") - F.col("q_lo")).alias("ci_high"))


def kde_grid(df: DataFrame, col: str, keys: Sequence[str] = (), grid_points: int = 200,
             bw_factor: float = 1.0, pre_bins: int = 2048) -> DataFrame:
    """Gaussian KDE on a grid per group, Scott bandwidth times factor.
    Data are first binned to ``pre_bins`` centres (binned KDE), so the work
    is grid x bins per group, not grid x rows."""
    keys = list(keys)
    d = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_x"))
    st = d.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"),
                              F.stddev_samp("_x").alias("_sd"))
    st = st.withColumn("_bw", F.lit(bw_factor) * F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(pre_bins)
    jd = d.join(st, keys) if keys else d.crossJoin(F.broadcast(st))
    binned = jd.withColumn("_b", F.when(w > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(pre_bins - 1)))
                           .otherwise(F.lit(0))) \
        .groupBy(*keys, "_b", "_lo", "_hi", "_n", "_bw").agg(F.count(F.lit(1)).alias("_c"))
    centre = F.col("_lo") + (F.col("_b") + 0.5) * w
    grid = F.sequence(F.lit(0), F.lit(grid_points - 1))
    gx = F.col("_lo") - 3 * F.col("_bw") + F.col("_gi") * (F.col("_hi") - F.col("_lo") + 6 * F.col("_bw")) / F.lit(grid_points - 1)
    e = binned.withColumn("_ctr", centre).withColumn("_gi", F.explode(grid)).withColumn("x", gx)
    z = F.try_divide(F.col("x") - F.col("_ctr"), F.col("_bw"))
    dens = F.try_divide(F.col("_c") * F.exp(-0.5 * z * z), F.col("_bw") * F.lit(np.sqrt(2 * np.pi)))
    return e.groupBy(*keys, "_gi", "x").agg((F.sum(dens) / F.first("_n")).alias("density")) \
        .withColumnRenamed("_gi", "grid_idx")


def logistic_curve(df: DataFrame, metric: str, label: str, grid_points: int = 100) -> DataFrame:
    """Unregularised logistic regression of a 0/1 label on one metric
    (Spark ML, distributed L-BFGS); returns the coefficients and the fitted
    curve on a grid between min and max."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    d = df.select(F.col(metric).cast("double").alias("x"), F.col(label).cast("double").alias("label")) \
        .filter(F.col("x").isNotNull() & F.col("label").isNotNull())
    va = VectorAssembler(inputCols=["x"], outputCol="features")
    model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-12).fit(va.transform(d))
    b0, b1 = float(model.intercept), float(model.coefficients[0])
    st = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = st.select(F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("i"), "lo", "hi")
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(grid_points - 1)
    return g.select(F.lit(metric).alias("metric"), F.lit(b0).alias("intercept"), F.lit(b1).alias("slope"),
                    x.alias("x"), (1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * x)))).alias("p"))


def pair_scatter(df: DataFrame, x: str, y: str, n: int, seed: int, id_col: str) -> DataFrame:
    """A seeded sample of ``n`` (x, y) pairs for a scatter plot, over rows that have both."""
    from .shape import sample_n
    df = materialised(df.select(id_col, x, y), "points")  # or the null filter computes x and y a second time
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(id_col, x, y)
    return sample_n(d, n, seed, id_col)


def local_linear(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), grid_points: int = 50,
                 frac: float = 0.3) -> DataFrame:
    """Local linear trend on a grid with tricube weights and a fixed
    bandwidth of ``frac`` x range (non-robust lowess). Rows shrink to count
    and sum of y per distinct x first, so the work is grid x distinct values.
    With a constant x every grid point is that x and gets the mean."""
    keys = list(keys)
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()) \
        .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_y"))
    st = d.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    jd = d.join(st, keys) if keys else d.crossJoin(F.broadcast(st))
    h = F.lit(frac) * (F.col("_hi") - F.col("_lo"))
    e = jd.withColumn("_gi", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1)))) \
        .withColumn("gx", F.col("_lo") + F.col("_gi") * (F.col("_hi") - F.col("_lo")) / F.lit(grid_points - 1))
    u = F.coalesce(F.try_divide(F.abs(F.col("_x") - F.col("gx")), h), F.lit(0.0))
    e = e.withColumn("_t", F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(0.0))).filter(F.col("_t") > 0) \
        .withColumn("_w", F.col("_t") * F.col("_n")).withColumn("_y", F.col("_y") / F.col("_n"))
    m = e.groupBy(*keys, "_gi", "gx").agg(
        F.sum("_w").alias("s0"), F.sum(F.col("_w") * F.col("_x")).alias("s1"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("s2"), F.sum(F.col("_w") * F.col("_y")).alias("t0"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    slope = F.try_divide(F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0"), det)
    icpt = F.try_divide(F.col("t0") - slope * F.col("s1"), F.col("s0"))
    fit = F.coalesce(icpt + slope * F.col("gx"), F.try_divide(F.col("t0"), F.col("s0")))
    return m.select(*keys, F.col("_gi").alias("grid_idx"), F.col("gx").alias("x"), fit.alias("y_hat"))


def _local_fits(pairs: DataFrame, grid: Sequence[float], spans: Sequence[float]) -> list[float | None]:
    """Weighted local linear fits at the grid points, from rows (_x, _y, _n, _r)."""
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g"), F.lit(h).alias("h")) for i, (g, h) in enumerate(zip(grid, spans, strict=True))])
    e = pairs.withColumn("_p", F.explode(points)).select("_x", "_y", "_n", "_r", "_p.*")
    d = F.abs(F.col("_x") - F.col("g"))
    e = e.filter((d < F.col("h")) | (d == 0)).withColumn("_w", F.when(d == 0, 1.0).otherwise(F.pow(1 - F.pow(d / F.col("h"), 3), 3)) * F.col("_r") * F.col("_n"))
    u = F.col("_x") - F.col("g")
    m = e.groupBy("i").agg(F.sum("_w").alias("s0"), F.sum(F.col("_w") * u).alias("s1"), F.sum(F.col("_w") * u * u).alias("s2"),
                           F.sum(F.col("_w") * F.col("_y")).alias("t0"), F.sum(F.col("_w") * u * F.col("_y")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.coalesce(F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.when(det > 0, det)), F.try_divide(F.col("t0"), F.col("s0")))
    found = {r["i"]: r["fit"] for r in m.select("i", fit.alias("fit")).collect()}  # a row per grid point
    return [found.get(i) for i in range(len(grid))]


def lowess(df: DataFrame, x: str, y: str, frac: float = 2 / 3, rounds: int = 3, grid_points: int = 40) -> DataFrame:
    """X21 as drawn: robust local trend, (grid_idx, x, y_hat) on an even grid.

    The window of a grid point reaches to its k-th nearest row, k = ``frac`` of
    the rows: distances are ranked over all tasks, none is held in one buffer.
    Rows inside weigh by the tricube of their distance. ``rounds`` times, the
    residuals (from the fit interpolated between grid points) give bisquare
    weights that end at six times their median, and the fit is repeated. Rows
    shrink to counts per (x, y) first; only a row per grid point comes to the
    driver. No rows give no points; a constant x gives one. A window whose rows
    all lie at its border has no fit (null)."""
    spark = df.sparkSession
    pairs = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    pairs = materialised(pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "pairs")
    lo, hi, n, largest = pairs.agg(F.min("_x"), F.max("_x"), F.sum("_n"), F.max(F.abs("_y"))).first()
    schema = "grid_idx int, x double, y_hat double"
    if n is None:
        return spark.createDataFrame([], schema)
    grid = [lo] if lo == hi else [lo + i * (hi - lo) / (grid_points - 1) for i in range(grid_points)]
    near = max(2, math.floor(frac * n + 1e-10))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grid)])
    far = pairs.withColumn("_p", F.explode(points)).groupBy(F.col("_p.i").alias("i"), F.abs(F.col("_x") - F.col("_p.g")).alias("d")).agg(F.sum("_n").alias("c"))
    cum = ranks.running_sum(materialised(far, "distances"), ["i"], ["d"], "_cum", weight=F.col("c"))
    spans = {r["i"]: r["h"] for r in cum.filter(F.col("_cum") >= min(near, n)).groupBy("i").agg(F.min("d").alias("h")).collect()}
    spans = [spans[i] for i in range(len(grid))]
    fits = _local_fits(pairs.withColumn("_r", F.lit(1.0)), grid, spans)
    for _ in range(rounds if len(grid) > 1 else 0):
        step = (hi - lo) / (len(grid) - 1)
        at = F.least(F.floor((F.col("_x") - lo) / step), F.lit(len(grid) - 2)).cast("int")
        values, left = F.array(*[F.lit(f).cast("double") for f in fits]), F.array(*[F.lit(g) for g in grid])
        fitted = F.get(values, at) + (F.col("_x") - F.get(left, at)) / step * (F.get(values, at + 1) - F.get(values, at))
        res = pairs.withColumn("_e", F.abs(F.col("_y") - fitted)).filter("_e is not null")
        cum = ranks.running_sum(materialised(res.groupBy("_e").agg(F.sum("_n").alias("c")), "residuals"), [], ["_e"], "_cum", weight=F.col("c"))
        middle = cum.agg(F.min(F.when(F.col("_cum") > (n - 1) // 2, F.col("_e"))).alias("a"), F.min(F.when(F.col("_cum") > n // 2, F.col("_e"))).alias("b")).first()
        if middle["a"] is None or middle["a"] + middle["b"] <= 1e-12 * largest:
            break  # half of the rows lie on the fit: nothing to weigh by
        reach = 3 * (middle["a"] + middle["b"])  # six medians
        fits = _local_fits(res.withColumn("_r", F.when(F.col("_e") < reach, F.pow(1 - F.pow(F.col("_e") / reach, 2), 2)).otherwise(0.0)).filter("_r > 0"), grid, spans)
    return spark.createDataFrame([(i, float(g), f) for i, (g, f) in enumerate(zip(grid, fits, strict=True))], schema)
