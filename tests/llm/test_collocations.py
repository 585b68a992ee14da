"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from mathgrade.llm import bitmaps, collocations, queries


def plain(rows, least, most, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        longer = [b for (g, q), b in found.items() if g == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(mine[:top], 1)]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_texts_and_longer_phrases(spark):
    rng = random.Random(5)
    words = ["A", "b", "Né", "d", "e e", "the", "x" * 300]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ? ", "\r"])
                                                     for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for most, least, top in ((3, 10, 2000), (4, 5, 7), (2, 3, 5)):
        assert got(collocations.collocations(docs, least, most, top)) == plain(rows, least, most, top)


def test_overlaps_hot_language_and_repeats(spark):
    """One language with nearly all rows, repeated rows, overlapping occurrences and a very long text without a piece end."""
    rows = [("en", "to be or not to be")] * 300 + [("de", "ja ja ja ja ja ja ja ja ja ja ja ja")] + [("fr", "la vie " * 20_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert got(collocations.collocations(docs)) == plain(rows, 10, 3, 2000)


def test_a_full_map_changes_nothing(spark, monkeypatch):
    """The semi-join only saves work: if every group passes it, the result is the same."""
    rng = random.Random(6)
    rows = [("en", " ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(400))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(bitmaps, "collected", lambda places, column, n_bits: np.full(n_bits // 8, 255, np.uint8))
    assert got(collocations.collocations(docs)) == plain(rows, 10, 3, 2000)


def test_odd_input(spark):
    """Nulls, empty texts, clashing columns, empty tables."""
    rows = [(None, None, 1, "x"), (None, "", 1, "x"), ("en", " \t.,", 1, "x")] + [(None, "a b. a\tb", 1, "x")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string, n int, phrase string")
    assert got(collocations.collocations(docs)) == [("und", 1, "a b", 10, 10, 10, 20, 1_000_000)]
    assert got(collocations.collocations(docs.limit(0))) == []
    assert got(collocations.collocations(docs.filter("lang = 'en'"))) == []


def test_exact_beyond_64_bits(spark):
    """Products of large counts stay exact."""
    from pyspark.sql import functions as F
    a, left, r = 3_000_000_007, 3_000_000_019, 4_000_000_007
    one = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(r).alias("r")).select(collocations.score().alias("s"))
    assert one.first().s == 1_000_000 * a * a // (left * r)


def test_query_on_the_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(queries.QUERIES["op12_collocations"](spark, sf)) == plain(docs, 10, 3, 2000)


def test_relations_are_read_in_small_batches(spark, monkeypatch):
    """A batch holds few blocks (all of a task's before), and the session's setting is as it was."""
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.sparkContext.accumulator(0)
    before, rows = spark.conf.get(key), collocations._rows

    def watched(batches):
        def each():
            for b in batches:
                if b.num_rows > 2:
                    most.add(1)
                yield b
        return rows(each())

    monkeypatch.setattr(collocations, "_rows", watched)
    docs = spark.createDataFrame([(f"l{i}", "red fox runs. " * 15) for i in range(40)], "lang string, text string").coalesce(1)
    out = collocations.collocations(docs).collect()  # a block per language
    assert sorted((r.lang, r.phrase, r.a) for r in out) == sorted((f"l{i}", "red fox runs", 15) for i in range(40))
    assert most.value == 0 and spark.conf.get(key) == before


def test_texts_are_read_in_bounded_batches(spark, monkeypatch):
    """Many short texts, and a few long ones: a batch was all of a task's up to 10,000 before."""
    tokens, longest, largest = collocations._tokens, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]

    def watched(batches):
        def each():
            for b in batches:
                longest.add(b.num_rows > 2000)
                largest.add(b.nbytes > 12 << 20)
                yield b
        return tokens(each())

    monkeypatch.setattr(collocations, "_tokens", watched)
    docs = spark.range(0, 5000, 1, 1).selectExpr("'en' AS lang", "if(id < 4960, 'red fox.', repeat('red fox. ', 100000)) AS text")
    assert [(r.phrase, r.a) for r in collocations.collocations(docs).collect()] == [("red fox", 4960 + 40 * 100_000)]
    assert longest.value == 0 and largest.value == 0 and [spark.conf.get(k) for k in keys] == before


def test_relations_are_stored_in_small_row_groups(spark, monkeypatch):
    """The blocks of a file came as one row group of one page a column before, up to 100 blocks."""
    monkeypatch.setattr(collocations, "GROUP_BYTES", 1 << 12, raising=False)
    kept, groups = collocations.stored, {}

    def watched(df, name, **options):
        out = kept(df, name, **options)
        files = [f.removeprefix("file:") for f in out.inputFiles()]
        groups[name] = [(m.num_rows, m.num_row_groups) for m in (pq.ParquetFile(re.sub("^//", "", f)).metadata for f in files)]
        return out

    monkeypatch.setattr(collocations, "stored", watched)
    docs = spark.createDataFrame([(f"l{i}", "red fox runs. " * 300) for i in range(40)], "lang string, text string").coalesce(1)
    out = collocations.collocations(docs).collect()
    assert sorted((r.lang, r.phrase, r.a) for r in out) == sorted((f"l{i}", "red fox runs", 300) for i in range(40))
    for name in ("occurrences-1", "occurrences-2"):
        assert sum(n for n, _ in groups[name]) == 40 and all(g > 1 for n, g in groups[name] if n > 20)
