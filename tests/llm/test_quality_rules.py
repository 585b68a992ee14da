"""The rule ledger against plain Python, policies and ablation."""

import re

import pytest

from mathgrade.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n\t", "one", "a b c d e f g h a b c d e f g h i", "line one\nline one\n\nline one\r\nother", "x " * 400,
         "### ** $$ word & more | <b>", "ÉÀ ALL CAPS " * 10, "same same same same words words words and so on " * 3, "dot\nlast\n", "\n\n\nabc\nabc",
         "the quick brown fox jumps over the lazy dog while many other animals look on and think about their own plans for dinner tonight",
         "wörd " * 30 + "end", "a\x0bb\x0cc d"]


def expected(text):
    t = text or ""
    w = WORD.findall(t)
    win = {}
    for i in range(len(w) - 7):
        win.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for at in win.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": sum("A" <= c <= "Z" for c in t), "n_letters": sum(c.isascii() and c.isalpha() for c in t),
            "n_stutter": sum(a == b for a, b in zip(w, w[1:]))}


def test_measurements(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "one")], "doc_id long, text string")
    rows = q.ledger(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "one"
        assert {m: r[m] for m in q.MEASURES} == expected(text), text


def test_measurements_do_not_depend_on_the_cut():
    import pyarrow as pa
    whole = q.measure(pa.array(TEXTS))
    small = q.pieces
    try:
        q.pieces = lambda c: small(c, limit=7)
        cut = q.measure(pa.array(TEXTS))
    finally:
        q.pieces = small
    assert all((whole[m] == cut[m]).all() for m in q.MEASURES)


def test_policies_and_ablation(spark):
    led = q.ledger(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    rows = q.apply_policy(led, q.POLICIES["v2"]).collect()
    for r in rows:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == base and (not base or not r.kept)
        assert r.kept == (r.fail_bits & q.POLICIES["v2"].mask == 0)
    for a in q.ablation(led).collect():
        bit, mask = 1 << list(q.RULES).index(a.rule), q.POLICIES[a.policy].mask
        assert a.n_docs == len(rows)
        assert a.n_failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert a.n_only_this == sum(r.fail_bits & mask == bit for r in rows)


@pytest.mark.parametrize("columns", ["doc_id long, text string, n_words string, fail_bits int, row int"])
def test_keep_leaves_rows_as_they_are(spark, columns):
    good = TEXTS[12]
    df = spark.createDataFrame([(1, good, "a", 5, 6), (2, None, "b", 5, 6), (1, good, "a", 5, 6)], columns)
    kept = q.keep(df, q.POLICIES["v2"])
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, good, "a", 5, 6)] * 2


def test_empty(spark):
    assert q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert q.ablation(q.ledger(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
