"""Passage removal against a plain search of every 50-byte string."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathgrade.llm import queries, suffix_dedup
from mathgrade.llm.common import salted_join
from mathgrade.llm.suffix_dedup import LENGTH, equal_suffixes


def plain(rows):
    """rows: (doc_id or None, text or None); (n_bytes, spans, kept) of each."""
    first = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for a in range(len(b) - LENGTH + 1):
            s = b[a:a + LENGTH]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for a in range(len(b) - LENGTH + 1):
            if first[b[a:a + LENGTH]] < i:
                gone[a + 1:a + LENGTH + 1] = True
        turn = np.flatnonzero(gone[1:] != gone[:-1])
        spans = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone[1:-1]) if not g)))
    return out


def check(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, **parameters).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1:])
    a = sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=key)
    b = sorted(((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True)), key=key)
    assert a == b
    return a


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdeé "
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 200))) for _ in range(6)] + ["ab" * 60, "a" * 130, "x" * 49, "é" * 40]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
                 for _ in range(rng.randint(0, 6))]
        t = "".join(parts)
        if rng.random() < 0.3 and t:
            a = rng.randrange(len(t))
            t = t[:a] + rng.choice(letters) + t[a + 1:]
        texts.append(t)
    texts += rng.sample(texts, n // 4)
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    got = check(spark, corpus(seed))
    assert sum(bool(x[2]) for x in got) > 30


def test_hot_anchors_and_crowded_ones(spark):
    """Anchors of many texts: merged stretches (hot=10), and windows one by one (hot=1)."""
    rng = random.Random(9)
    line = "this line of more than fifty bytes stands in a third of all documents, and "
    rows = corpus(7, 40) + [(20_000 + i, line + "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 80)))) for i in range(40)]
    for hot in (10, 1):
        check(spark, rows, hot=hot)


def test_odd_input(spark):
    """Nulls, empty texts, shared and null ids, copies among null ids, one very long text, a text of one character."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    a = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(None, None), (1, ""), (1, None), (5, a), (5, a), (5, a + "zz"), (7, a), (None, a[20:90]), (None, a[20:90]), (None, "q" * 60),
            (None, "q" * 71), (8, long), (9, long[500_000:560_000] + a), (10, "z" * 500), (11, "z" * 49)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, kept string").repartition(3)
    got = {(r.doc_id, r.n_bytes): [(s.start, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[5, 120] == [] and got[5, 122] == [] and got[7, 120] == [(0, 120)] and got[None, 70] == [(0, 70)] and got[None, 71] == []
    assert got[9, 60_120] == [(0, 60_120)] and got[8, 1_200_000] == [] and got[10, 500] == [] and got[11, 49] == [] and got[1, 0] == []
    check(spark, [r for r in rows if r[0] not in (8, 9)])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_deep_shallow_sort_groups():
    """Groups of equal strings, decided in the quicksort, at the first and at the last byte of a trie."""
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(60))
    texts = [base, base, base[:49] + b"c" + base[50:], base[:24] + b"c" + base[25:], base[:24] + b"c" + base[25:], b"q" + base[1:],
             base[:40] + b"d" + base[41:], base]
    starts = np.arange(len(texts)) * 60
    suffix, group = equal_suffixes(np.frombuffer(b"".join(texts), np.uint8), starts)
    groups = {}
    for s, g in zip(suffix.tolist(), group.tolist()):
        groups.setdefault(g, set()).add(s)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 7], [3, 4]]


def test_query_on_the_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_suffix_dedup"](spark, sf).collect()}
    for (i, _), (n, spans, kept) in zip(docs, plain(docs), strict=True):
        assert got[i] == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_strings_that_repeat_by_chance_are_not_sent(spark, monkeypatch):
    """A repeated string of ``ANCHOR`` bytes or some more isn't a repeated window: its stretches stay where they are."""
    rng, cover, sent = random.Random(11), suffix_dedup._cover, spark.sparkContext.accumulator(0)

    def watched(batches):
        def each():
            for b in batches:
                sent.add(b.num_rows)
                yield b
        return cover(each())

    monkeypatch.setattr(suffix_dedup, "_cover", watched)
    letters = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    common = [letters(26) for _ in range(8)]
    rows = [(i, "".join(letters(60) + c for c in common) + letters(60)) for i in range(40)]
    assert not any(x[2] for x in check(spark, rows)) and sent.value == 0
    check(spark, rows + [(100, rows[3][1][200:300])])
    assert 0 < sent.value < 40


def test_spans_are_merged_before_they_meet_the_texts(spark, monkeypatch):
    rng, cut, most = random.Random(12), suffix_dedup._cut, spark.sparkContext.accumulator(0)

    def watched(batches):
        def each():
            for b in batches:
                most.add(sum(len(x or ()) for x in b.column("found").to_pylist()))
                yield b
        return cut(each())

    monkeypatch.setattr(suffix_dedup, "_cut", watched)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    got = check(spark, [(1, "head " + long), (2, "x" + long[:1400] + "--" + long[1400:] + "y")])
    assert [len(x[2]) for x in got] == [0, 2] and most.value == 2  # one per stretch before


def test_only_keys_of_many_rows_are_spread(spark):
    """A join that keeps the unmatched copies of the right side's rows shows how many there are."""
    left = spark.createDataFrame([(k, i, k == 1) for k in (1, 2) for i in range(50)], "k int, i int, m boolean")
    right = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False)], "k int, v string, m boolean")
    assert sorted(tuple(r) for r in salted_join(left, right, ["k"], F.col("i"), many="m").collect()) == \
        sorted((k, i, "ab"[k - 1]) for k in (1, 2) for i in range(50))
    few = salted_join(left.filter("i = 0"), right, ["k"], F.col("i"), how="right", many="m").groupBy("k").count().collect()
    assert sorted(tuple(r) for r in few) == [(1, 8), (2, 1), (3, 1)]
