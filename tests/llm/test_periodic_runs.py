"""Periodic runs against a direct search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathgrade.llm import periodic_runs, queries
from mathgrade.llm.periodic_runs import find_runs


def plain_runs(words):
    out = []
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            smaller = any(all(words[j] == words[j + d] for j in range(s, e - d)) for d in range(1, q) if q % d == 0)
            if e - s >= max(24, 3 * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left))


def cut(text):
    return (text or "").encode().split()


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def made(rng):
    """Words with nested, overlapping, touching and near-miss runs of short and long periods."""
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        else:
            unit = [rng.choice("abc" if kind < 0.6 else "abcdefghijklmnop") for _ in range(rng.randint(1, 60))]
            if kind > 0.8:
                unit = unit * rng.randint(1, 3) + [rng.choice("abc")]
            n = rng.randint(len(unit), 6 * len(unit) + 3)
            out += [unit[i % len(unit)] for i in range(n)]
            if rng.random() < 0.5:
                out[-1] = "z"
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_sequences(seed):
    rng = random.Random(seed)
    docs = [made(rng) for _ in range(25)]
    number = {w: i for i, w in enumerate("abcdefghijklmnopz")}
    lengths = np.array([len(d) for d in docs])
    x = np.concatenate([np.array([number[w] for w in d] + [-1 - i]) for i, d in enumerate(docs)])
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    got = sorted(find_runs(x, lengths))
    want = sorted((s + int(first[i]), n, q) for i, d in enumerate(docs) for s, n, q in plain_runs(d))
    assert got == want


def test_every_period_at_the_least_exponent():
    """Three periods exactly, of every length over many scales."""
    for q in range(1, 300, 7):
        n = max(24, 3 * q)
        x = np.array([i % q for i in range(n)] + [-1])
        assert find_runs(x, np.array([n])) == [(0, n, q)]
        if n > 24:
            assert find_runs(np.delete(x, 0), np.array([n - 1])) == []


def test_query_equals_plain_python(spark, sf):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and sum(r.n_runs for r in rows.values()) > 10
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    checked = 0
    for d in docs:
        words = [w.decode() for w in plant(d.doc_id, cut(d.text))]
        if len(words) > 1500:
            continue  # the plain search is quadratic; random sequences above cover long periods
        assert tuple(rows[d.doc_id][c] for c in columns) == plain_row(words), d.doc_id
        checked += 1
    assert checked > 150


def test_odd_input(spark):
    """Nulls, empty and separator-only texts, repeated rows, clashing names and one very long text."""
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [(None, None, 1, "x"), (None, "a " * 30, 1, "x"), (2, "", 1, "x"), (2, "\t \n", 1, "x"), (3, "a\tb\n" * 12, 1, "x"),
            (3, "a\tb\n" * 12, 1, "x"), (4, long, 1, "x"), (5, "a\u00a0b " * 24, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, best string")
    got = periodic_runs.periodic_runs(periodic_runs.planted(docs.withColumn("doc_id", F.col("doc_id"))))
    assert got.columns == ["doc_id", "text", "runs", "best", "collapsed"]
    plain = periodic_runs.periodic_runs(docs).collect()
    runs = [[tuple(r) for r in x.runs] for x in plain]
    assert runs == [[], [(0, 30, 1)], [], [], [(0, 24, 2)], [(0, 24, 2)], [(0, 20_000, 5000)], [(0, 24, 1)]]
    assert [x.collapsed for x in plain][:6] == ["", "a", "", "", "a b", "a b"]
    assert plain[-1].collapsed == "a\u00a0b"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
