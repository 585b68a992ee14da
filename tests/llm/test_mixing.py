"""The mix against a plain Python queue, and its promises."""

import hashlib
import re

import pytest

from mathgrade.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, free, target = sum(sizes.values()), {s for s in names if sizes[s]}, {s: 0.0 for s in names}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * budget > 3 * sizes[s] * total}
        if not over:
            target |= {s: weight[s] * budget / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            budget -= 3 * sizes[s]
        free -= over
    return target


def plain_mix(rows):
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    sizes = {}
    for (_, s, _), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    turn = [hashlib.md5((("" if d is None else str(d)) + ":mix").encode()).hexdigest() for d, _, _ in rows]
    entries = []
    for s in sizes:
        mine = [i for i, r in enumerate(rows) if r[1] == s]
        for i in mine:
            queued = sum(size[j] for j in mine if (turn[j], size[j]) <= (turn[i], size[i]))
            entries += [((queued + e * sizes[s]) / target[s], turn[i], size[i], i) for e in range(3) if size[i] and target[s]]
    budget, taken = sum(size), [0] * len(rows)
    for e in entries:
        if sum(x[2] for x in entries if x[:3] <= e[:3]) <= budget:
            taken[e[3]] += e[2]
    return [(d, n, sizes[s], round(target[s], 6), k) for (d, s, _), n, k in zip(rows, size, taken)]


CASES = {
    "ordinary": [(i, ["a", "b", "c", "d", None][i % 5], "w " * (i * 7 % 23)) for i in range(120)],
    "capped": [(i, "a" if i < 3 else "b" if i < 80 else "c", "w " * 5) for i in range(100)],
    "one": [(1, "a", "one two")],
    "odd": [(1, "a", None), (None, "a", "x"), (None, "a", "x y"), (2, None, ""), (2, "z", "q"), (2, "z", "q"), (3, "é", "x " * 4000)],
    "no words": [(1, "a", ""), (2, "b", None)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_equals_a_plain_queue(spark, case, bucket_rows):
    rows = CASES[case]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df, bucket_rows=bucket_rows).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(plain_mix(rows), key=key)
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_shares_come_near_their_targets(spark):
    rows = [(i, f"s{i % 4 if i % 3 else 0}", "w " * (5 + i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, bucket_rows=100).groupBy("source", "target").sum("taken").collect()
    assert len(got) == 4
    for r in got:
        assert abs(r["sum(taken)"] - r.target) <= 0.02 * r.target + 30


def test_take_repeats_documents(spark):
    rows = CASES["capped"]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, copies int, _size string")
    out = mixing.take(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: k for d, _, _, _, k in plain_mix(rows) if k}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0 and mixing.take(df).count() == 0
