"""The pipeline against plain Python, stage by stage and as a whole."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline

from .test_byte_bpe import LIBRARY
from .test_mixing import plain_mix
from .test_near_dup import brute
from .test_quality_rules import expected


def plain_quality(text):
    m = expected(text)
    n, lines = m["n_words"], m["n_lines"]
    return not (n < 20 or 100 * m["n_repeat_words"] > 30 * n or 100 * m["n_symbols"] > 30 * n or 100 * m["n_dup_lines"] > 50 * lines
                or m["word_chars"] < 2 * n or m["word_chars"] > 20 * n or 100 * m["n_upper"] > 50 * m["n_letters"] or 100 * m["n_stutter"] > 30 * n)


def test_whole_run(spark, sf):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [d for d in docs if plain_quality(d[2])]  # every rejection of a language here would show below
    kept = {doc for doc, _, _, first in brute([(d, t) for d, _, t in docs]) if first}
    docs = [d for d in docs if d[0] in kept]
    text = {d: t for d, _, t in docs}
    copies = {d: taken // size for d, size, _, _, taken in plain_mix(docs) if taken}
    want = Counter()
    for d, k in copies.items():
        ids = LIBRARY.encode_ordinary(text[d])
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[d].encode()).hexdigest()] = k
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    long = " ".join(f"word{i % 700}" for i in range(40_000))
    rows = [(1, None, "en", "a", None, 7), (2, "", None, None, 0, 7), (3, long, "en", "a", len(long), 7), (3, long, "en", "a", len(long), 7), (None, long + " end", None, "b", 1, 7)]
    rows += [(10 + i, f"plain text number {i} with some words that go on for a while so that the rules let it pass as it is " + f"x{i} " * 3, "en", "c", 1, 7) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert out.count() > 0
        none = stage(spark, docs.filter("false"), sf)
        assert none.count() == 0 and none.columns == out.columns
