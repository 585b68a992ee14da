"""Distributed ranks against pandas, with one key holding a third of all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mathgrade.operators import aggregate as AG
from mathgrade.operators import ranks


def _skewed(spark, n=3000):
    rng = np.random.default_rng(0)
    key = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 50, n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": rng.integers(0, 40, n).astype(float)})
    return spark.createDataFrame(pdf), pdf


def test_index_within_group_skewed(spark):
    df, pdf = _skewed(spark)
    got = ranks.index_within_group(df, ["k"], ["v", "id"], "idx").toPandas().set_index("id").sort_index()
    exp = pdf.sort_values(["k", "v", "id"]).groupby("k").cumcount().sort_index()
    assert (got["idx"].values == exp.values).all()


def test_global_index_and_average_ranks(spark):
    df, pdf = _skewed(spark)
    g = ranks.global_index(df, ["v", "id"], "pos").toPandas().set_index("id").sort_index()
    exp = pdf.sort_values(["v", "id"]).reset_index(drop=True).reset_index().set_index("id").sort_index()["index"]
    assert (g["pos"].values == exp.values).all()
    ar = ranks.average_ranks(df, "v").toPandas().set_index("v").sort_index()
    ranked = pdf.assign(r=pdf["v"].rank(method="average")).groupby("v")["r"].first().sort_index()
    assert np.allclose(ar["avg_rank"].values, ranked.values)


def test_drop_consecutive_repeats(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "b"), (2, 2, "b")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    out = sorted((r.k, r.t) for r in AG.drop_consecutive_repeats(df, "k", ["t"], "v").collect())
    assert out == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_best_per_group_first_wins_ties(spark):
    rows = [(1, 0, 0.5, 0.1), (1, 1, 0.5, 0.1), (1, 2, 0.4, 0.9), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "src int, cand int, novelty double, difficulty double")
    b = AG.best_per_group(df, ["src"], F.struct("novelty", "difficulty", (-F.col("cand")).alias("c")))
    got = {r.src: r.cand for r in b.collect()}
    assert got[1] == 0


def test_exact_quantiles_skewed(spark):
    df, pdf = _skewed(spark)
    got = ranks.quantiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0], ["k"]).toPandas().set_index("k").sort_index()
    exp = pdf.groupby("k")["v"].quantile([0.0, 0.25, 0.5, 0.95, 1.0]).unstack().sort_index()
    assert np.allclose(got[[f"q_{i}" for i in range(5)]].values, exp.values)
    one = ranks.quantiles(df, "v", [0.3]).first()
    assert one.n == len(pdf) and abs(one.q_0 - pdf["v"].quantile(0.3)) < 1e-12
    assert ranks.quantiles(df.filter("false"), "v", [0.5], ["k"]).count() == 0


def test_group_sizes_are_salted(spark):
    df, pdf = _skewed(spark)
    out = AG.attach_group_size(df, "k", "n")
    got = out.toPandas().set_index("id").sort_index()
    assert (got["n"].values == pdf.groupby("k")["id"].transform("count").values).all()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_row_number_default_and_ranks_without_checkpoints(spark):
    from mathgrade.operators import shape as SH
    df, pdf = _skewed(spark, 300)
    got = SH.default_column(df, "source_idx", order=["v", "id"]).toPandas().sort_values(["v", "id"])
    assert got["source_idx"].tolist() == list(range(300))
    assert SH.default_column(df, "v", order=["id"]).columns == df.columns


def test_bucket_sizes_follow_the_rows(spark):
    """No bucket far above its target, at one and two levels, at several shuffle settings, with long equal prefixes."""
    n = 20_000
    df = spark.range(n, numPartitions=6).select(F.concat(F.lit("x" * 40), F.md5(F.col("id").cast("string"))).alias("s"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shuffles in ("2", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            for target, fanout in ((1000, 512), (250, 16), (100, 15)):
                sizes = ranks.bucketed(df, ["s", "id"], rows_per_bucket=target, fanout=fanout).groupBy("_b").count().toPandas()["count"]
                assert sizes.sum() == n and sizes.max() <= 5 * target, (shuffles, target, sizes.max())
                got = ranks.running_sum(df, [], ["s", "id"], "rn", rows_per_bucket=target, fanout=fanout).toPandas().sort_values(["s", "id"])
                assert (got["rn"].to_numpy() == np.arange(1, n + 1)).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_number_of_buckets():
    assert ranks.n_buckets(0, 200) == 1 and ranks.n_buckets(10_000, 200) == 1
    assert ranks.n_buckets(10**6, 16) == 16 and ranks.n_buckets(10**9, 16) == 4000
    assert ranks.n_buckets(10**12, 16) == ranks.FANOUT ** 2  # about four million rows each


def test_hot_group_over_two_levels(spark):
    df, pdf = _skewed(spark)
    got = ranks.running_sum(df, ["k"], ["v", "id"], "c", weight=F.col("id") + 1, rows_per_bucket=50, fanout=9).toPandas().set_index("id").sort_index()
    exp = pdf.assign(w=pdf["id"] + 1).sort_values(["k", "v", "id"])
    exp = exp.assign(c=exp.groupby("k")["w"].cumsum()).set_index("id").sort_index()["c"]
    assert (got["c"].to_numpy() == exp.to_numpy()).all()


def test_nulls_in_keys_and_order(spark):
    rows = [(None, None, 1), (None, 2.0, 2), ("a", None, 3), ("a", 1.0, 4)] * 40
    df = spark.createDataFrame([(k, v, i, j) for j, (k, v, i) in enumerate(rows)], "k string, v double, i int, id int")
    got = ranks.running_sum(df, ["k"], ["v", "id"], "rn", rows_per_bucket=10, fanout=5).toPandas()
    for _, part in got.groupby("k", dropna=False):
        ordered = part.sort_values(["v", "id"], na_position="first")
        assert (ordered["rn"].to_numpy() == np.arange(1, len(part) + 1)).all()
