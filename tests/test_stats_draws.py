"""Counter-based bootstrap draws and hexagonal bins."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from mathgrade.operators import stats as X


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("ab"[i % 2], rng.gauss(3, 2)) for i in range(300)], "g string, x double")
    few, many = (sorted(map(tuple, X.bootstrap_mean_ci(df.repartition(n), ["g"], "x", replicates=300).collect())) for n in (1, 9))
    assert [r[:2] for r in few] == [r[:2] for r in many] and np.allclose([r[2:] for r in few], [r[2:] for r in many], rtol=1e-12)


def test_bootstrap_interval_has_the_width_of_the_mean_s_error(spark):
    """Against the normal interval, for values seen once and for values seen a thousand times (normal weights)."""
    rng = np.random.default_rng(3)
    once = rng.gamma(2.0, 3.0, 400)
    often = np.repeat([1.0, 4.0, 9.0], [3000, 1000, 2000])
    for x in (once, often):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        r = X.bootstrap_mean_ci(df, [], "x", replicates=1500).first()
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert r.n == len(x) and abs(r.mean - x.mean()) < 1e-9
        assert abs((r.ci_high - r.ci_low) / 2 / half - 1) < 0.12 and abs((r.ci_high + r.ci_low) / 2 - x.mean()) < 0.25 * half


def test_poisson_edges():
    edges = np.array(X.poisson_edges()) / X.DRAW_PRIME
    assert abs(edges[0] - math.exp(-1)) < 1e-8 and (np.diff(edges) >= 0).all() and 1 - edges[-1] < 1e-9
    assert abs((1 - edges).sum() - 1) < 1e-6  # the mean of Poisson(1)


def test_hexagons(spark):
    """Every row counts once, and lies nearest to its own centre (in steps in which the hexagons are regular)."""
    rng = random.Random(5)
    pts = [(rng.uniform(-2, 5), rng.gauss(0, 3)) for _ in range(700)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(pts, "x double, y double")
    rows = X.hexagons(df, "x", "y", 12).collect()
    assert sum(r["count"] for r in rows) == 700
    good = [p for p in pts if None not in p]
    x0, x1 = min(p[0] for p in good), max(p[0] for p in good)
    y0, y1 = min(p[1] for p in good), max(p[1] for p in good)
    sx, sy, ny = (x1 - x0) / 12, (y1 - y0) / 6, 6
    centres = [(x0 + (i + k / 2) * sx, y0 + (j + k / 2) * sy, k) for k in (0, 1) for i in range(-1, 14) for j in range(-1, ny + 2)]
    want = {}
    for p in good:
        # the extreme points are as near to two centres: then the second lattice and the larger one
        c = min(centres, key=lambda c: (round(((p[0] - c[0]) / sx) ** 2 + 3 * ((p[1] - c[1]) / sy) ** 2, 9), -c[2], -c[0], -c[1]))
        want[round(c[0], 9), round(c[1], 9)] = want.get((round(c[0], 9), round(c[1], 9)), 0) + 1
    assert {(round(r.x_centre, 9), round(r.y_centre, 9)): r["count"] for r in rows} == want
    same = df.filter("x is not null and y is not null").withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0))
    assert [(r.lattice, r.x_bin, r.y_bin, r["count"]) for r in X.hexagons(same, "x", "y", 5).collect()] == [(0, 0, 0, 700)]
    assert X.hexagons(df.limit(0), "x", "y").count() == 0


def plain_lowess(x, y, frac, rounds, points):
    n, lo, hi = len(x), x.min(), x.max()
    grid = np.linspace(lo, hi, points)
    k = int(frac * n + 1e-10)
    span = np.array([np.sort(np.abs(x - g))[k - 1] for g in grid])
    r = np.ones(n)
    for turn in range(rounds + 1):
        fit = []
        for g, h in zip(grid, span):
            w = np.where(np.abs(x - g) < h, (1 - (np.abs(x - g) / h) ** 3) ** 3, 0) * r
            b, a = np.polyfit(x - g, y, 1, w=np.sqrt(w))
            fit.append(a)
        res = np.abs(y - np.interp(x, grid, fit))
        s = 6 * np.median(res)
        r = np.where(res < s, (1 - (res / s) ** 2) ** 2, 0)
    return grid, np.array(fit)


def test_lowess_equals_the_plain_form_and_resists_outliers(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(0, 10, 300), 2)
    y = 2 * x + rng.normal(0, 0.5, 300)
    wild = y.copy()
    wild[rng.choice(300, 20, replace=False)] += 60
    for data in (y, wild):
        got = X.lowess(spark.createDataFrame(list(zip(x.tolist(), data.tolist())), "x double, y double"), "x", "y", 0.5, 3, 21).collect()
        grid, fit = plain_lowess(x, data, 0.5, 3, 21)
        assert np.allclose([r.x for r in got], grid) and np.allclose([r.y_hat for r in got], fit, atol=1e-6)
        assert np.abs(fit - 2 * grid).max() < 0.6  # twenty wild rows don't move it
    once = X.lowess(spark.createDataFrame(list(zip(x.tolist(), wild.tolist())), "x double, y double"), "x", "y", 0.5, 0, 21).collect()
    assert max(abs(r.y_hat - 2 * r.x) for r in once) > 2  # without the rounds they do


def test_lowess_odd_input(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 1.0), (2.0, None)], "x double, y double")
    assert [(r.x, r.y_hat) for r in X.lowess(df, "x", "y").collect()] == [(1.0, 3.0)]
    assert X.lowess(df.limit(0), "x", "y").count() == 0
    two = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    assert [r.y_hat for r in X.lowess(two, "x", "y", 1.0, 3, 3).collect()] == [1.0, None, 3.0]
