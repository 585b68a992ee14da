"""Graph search against brute force."""

import numpy as np
import pytest

from mathgrade.llm import vector_graph as vg


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = {}
            for i, y in ok:
                if i != q and len(y) == len(x):
                    near[i] = min(near.get(i, np.inf), float(np.sqrt(((x - y) ** 2).sum())))
            mine = out.setdefault(q, {})
            for i, d in near.items():
                mine[i] = min(mine.get(i, np.inf), d)
    return {q: sorted((d, i) for i, d in m.items())[:k] for q, m in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        mine = out.setdefault(r.query_id, [])
        mine.append((r.score, r.vec_id))
        assert r["rank"] == len(mine)
    return out


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).astype(float)


def test_recall_and_exact_scores(spark):
    x = vectors(3000, 24, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(vg.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=60))
    want = brute(rows, 10, 60)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q in got:
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        for d, i in got[q]:
            assert d == pytest.approx(float(np.sqrt(((x[q] - x[i]) ** 2).sum())), rel=1e-12)


def test_small_shards_equal_brute_force(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(200, 6, 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(vg.search(df.filter("vec_id % 20 = 0"), vg.build(df, 10, 25), 10, block=3))
    want = brute(rows, 10, 20)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_odd_vectors_and_a_hot_one(spark):
    x = vectors(60, 3, 3).tolist()
    rows = [(i, x[i]) for i in range(60)] + [(1000 + i, x[0]) for i in range(40)] + [
        (100, None), (200, []), (300, [0.0, 0.0, 0.0]), (400, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (600, [1.0, None, 2.0]),
        (None, [1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (800, [2.0, 1.0]), (0, x[0]), (900, [-0.0, 0.0, 1.0]), (901, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, ids string")
    got, want = found(vg.nearest(df)), brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 10, 100)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_a_third_of_the_rows_repeat_one_id_and_vector(spark):
    """They are one candidate, and no list of the nodes grows with them."""
    x = vectors(400, 4, 5).tolist()
    rows = [(i, x[i]) for i in range(400)] + [(7, x[7])] * 150 + [(1000 + i, x[9]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    ids = vg.nodes(df, 10).collect()
    assert len(ids) == 400 and max(len(r.ids) for r in ids) == 11 and [r.ids for r in ids if 7 in r.ids] == [[7]]
    got, want = found(vg.nearest(df)), brute([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 10, 100)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_empty(spark):
    assert vg.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
