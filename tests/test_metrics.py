"""pass@k, entropy and p-value identities and brute force comparisons."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathgrade.operators import metrics as M
from mathgrade.operators import stats as X


def brute_pass_at_k(n, c, k):
    k = min(k, n)
    if c == 0:
        return 0.0
    flags = [1] * c + [0] * (n - c)
    subsets = list(combinations(range(n), k))
    return sum(1 for s in subsets if any(flags[i] for i in s)) / len(subsets)


def test_pass_at_k_brute_force(spark):
    cases = [(n, c, k) for n in range(1, 8) for c in range(0, n + 1) for k in (1, 2, 3, 10)]
    df = spark.createDataFrame(cases, "n long, c long, k int")
    got = df.select("n", "c", "k", M.pass_at_k_expr("n", "c", F.col("k")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(brute_pass_at_k(r.n, r.c, r.k), abs=1e-12)
        if r.n >= 1:
            assert r.p == pytest.approx(1 - math.comb(r.n - r.c, min(r.k, r.n)) / math.comb(r.n, min(r.k, r.n)))


def test_pass_identities_and_permutation(spark):
    rows = [(q, s, (q * 7 + s * 3) % 4 == 0) for q in range(50) for s in range(1 + q % 6)]
    df = spark.createDataFrame(rows, "question_id long, sample_number int, correct boolean")
    p = M.pass_at_k(df, ks=(1, 6)).toPandas().set_index("question_id")
    acc = df.groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("a")).toPandas().set_index("question_id")
    assert np.allclose(p["pass_at_1"], acc.loc[p.index, "a"])  # pass@1 = mean correctness
    anyc = df.groupBy("question_id").agg(F.max(F.col("correct").cast("double")).alias("m")).toPandas().set_index("question_id")
    assert np.allclose(p["pass_at_6"], anyc.loc[p.index, "m"])  # pass@n = any correct
    p2 = M.pass_at_k(df.repartition(7).orderBy(F.rand(3)), ks=(1, 6)).toPandas().set_index("question_id")
    assert np.allclose(p2.loc[p.index, "pass_at_1"], p["pass_at_1"])


def test_voting_entropy(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "question_id long, answer string")
    out = {r.question_id: r.voting_entropy for r in M.voting_entropy(df).collect()}
    assert out[1] == 0.0
    assert out[2] == pytest.approx(math.log(2))
    assert out[3] == pytest.approx(-(0.25 * math.log(0.25) * 2 + 0.5 * math.log(0.5)))


def test_t_pvalues_known():
    # two-sided p of t with df: t=2.228, df=10 -> 0.05; t=1.96, df=1e6 -> ~0.05; t=0 -> 1
    p = X.t_two_sided_p(np.array([2.228, 1.959964, 0.0, 3.169]), np.array([10, 1e6, 5, 10]))
    assert p[0] == pytest.approx(0.05, abs=2e-4)
    assert p[1] == pytest.approx(0.05, abs=1e-5)
    assert p[2] == pytest.approx(1.0)
    assert p[3] == pytest.approx(0.01, abs=2e-4)


def test_logsoftmax_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "logits array<double>, target int")
    r = df.select(M.gather_logp("logits", "target").alias("lp"), M.distribution_entropy("logits").alias("h")).first()
    z = np.array([1.0, 2.0, 3.0])
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert r.lp == pytest.approx(np.log(p[2]))
    assert r.h == pytest.approx(-(p * np.log(p + 1e-12)).sum())


def test_targets_outside_the_vocabulary_and_sequences(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], t) for t in (0, 2, 3, -1, -100, None)], "z array<double>, t int")
    got = [r.v for r in df.select(M.gather_logp("z", "t").alias("v")).collect()]
    lse = math.log(sum(math.exp(x) for x in (1, 2, 3)))
    assert got[0] == pytest.approx(1 - lse) and got[1] == pytest.approx(3 - lse) and got[2:] == [None] * 4
    rows = [([[1.0, 2.0], [0.0, 0.0], [3.0, 1.0], [9.0, 9.0]], [0, 1, 0, 1], 2), ([[1.0, 2.0]], [1], 0), ([], [], 0)]
    df = spark.createDataFrame(rows, "z array<array<double>>, ids array<int>, p int")
    a, b, c = [r.s for r in df.select(M.sequence_scores("z", "ids", F.col("p")).alias("s")).collect()]
    assert a.n_tokens == 2 and a.logp == pytest.approx([math.log(0.5), 1 - math.log(math.exp(3) + math.exp(1))])
    p = math.exp(3) / (math.exp(3) + math.exp(1))
    assert a.mean_entropy == pytest.approx((math.log(2) - p * math.log(p) - (1 - p) * math.log(1 - p)) / 2)
    assert (b.logp, b.mean_entropy, b.n_tokens) == ([], None, 0) and c.n_tokens == 0
