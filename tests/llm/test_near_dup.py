"""Near-duplicates against brute force, with odd rows and small limits."""

import re
from collections import Counter

import numpy as np
import pytest

from mathgrade.llm import components, near_dup
from mathgrade.llm.wordbytes import pieces, span_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same_id or both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        comp = min(members) if members and sets[i] else doc
        out.append((doc, len(sets[i]), comp, doc == comp))
    return sorted(out, key=repr)


def corpus(n=160, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = vocabulary[rng.integers(400)]
        else:
            words = [vocabulary[k] for k in rng.integers(0, 400, rng.integers(40, 90))]
        texts.append(" ".join(words))
        rows.append((1000 - i, texts[-1]))
    return rows


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "é è ê ë ï ô"), (8, "É è ê ë ï ô"),
       (9, "x " * 3000), (9, "x " * 3000), (10, "a b c d e f g h"), (10, "q r s t u v w x"), (None, "one two"), (None, "alone here"), (11, "a b c d e f g h")]


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"leaf": 3, "task_node": 8, "family_sets": 3, "block": 4}])
def test_equals_brute_force(spark, limits):
    rows = corpus() + ODD
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, sig string, family int")
    assert found(near_dup.near_duplicates(df, **limits)) == brute(rows)


def test_blocks_keep_the_bound_of_shingles(spark):
    """A family of few long sets is cut by shingles: no block and no pair of blocks passes the bound."""
    size, bound = 500, 60_000
    rows = [(f, f * 1000 + i, b"\0" * (8 * size)) for f, n in ((1, 300), (2, 130)) for i in range(n)]
    members = near_dup._blocks(spark.createDataFrame(rows, "family long, id long, shingles binary"), near_dup.BLOCK, bound).collect()
    assert len(members) == len(rows)
    for f in (1, 2):
        sizes = Counter(r.block for r in members if r.family == f)
        assert len(sizes) > 1 and size * sum(k for _, k in sizes.most_common(2)) <= bound


def test_family_of_long_sets_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 4000, 300)]
    rows = []
    for i in range(50):
        words = base if i % 5 else base[::-1]
        rows.append((i, " ".join(w if rng.random() > 0.01 else f"x{i}" for w in words)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(corpus(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dup.near_duplicates(df, family_shingles=2_000)) == brute(rows)


def test_one_group_holds_a_third(spark):
    rows = corpus(60) + [(2000 + i, "same words in every copy of this text and more") for i in range(40)]
    assert found(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near(words, *changes):
    out = list(words)
    for at, w in changes:
        out[at] = w
    return " ".join(out)


BRIDGE = [f"w{i}" for i in range(60)]
#: 1 and 2 link only through a row without an id; two rows without ids link with each other alone, one stands alone.
NULLS = [(1, near(BRIDGE, (5, "a"))), (None, near(BRIDGE)), (2, near(BRIDGE, (50, "b"))), (None, near(BRIDGE)),
         (None, near(BRIDGE[::-1])), (None, near(BRIDGE[::-1], (30, "c"))), (None, near(BRIDGE[::-1])), (None, "all alone here"), (None, None),
         (None, None), (7, near(BRIDGE, (20, "x"), (21, "y"), (40, "z")))]


@pytest.mark.parametrize("limits", [{}, {"leaf": 2, "task_node": 3, "family_sets": 2, "block": 1}])
def test_links_through_rows_without_an_id(spark, limits):
    df = spark.createDataFrame(NULLS, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(df, **limits).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 7: 7}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None and r.n_shingles > 5) \
        == sorted([(1, False), (1, False)] + [(0, k) for k in _kept_of_two(got)])
    assert found(near_dup.near_duplicates(df.filter("doc_id is not null"))) == brute([r for r in NULLS if r[0]])


def _kept_of_two(got):
    """Of two texts without ids, one of which stands in two rows, one text is kept: in one row or in two."""
    kept = [r.kept for r in got if r.doc_id is None and r.n_shingles > 5 and r.component_id is None]
    assert sorted(kept) in ([False, False, True], [False, True, True])
    return kept


def test_keep_one_without_ids(spark):
    rows = [(*r, i) for i, r in enumerate(NULLS)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 7]
    texts = [r.text for r in kept if r.doc_id is None]
    assert len(texts) == 3 and texts.count(None) == 1 and "all alone here" in texts and sum((t or "").startswith("w59") for t in texts) == 1


def test_keep_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "other words stand here alone")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert kept.columns == ["doc_id", "text"]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 299)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(60)} | {299: 299, 300: 299}


def test_word_hashes_follow_words():
    import pyarrow as pa
    texts = ["a b", None, " b\ta ", "", "ab", "b"]
    hashes = []
    for _, _, data, off in pieces(pa.array(texts), limit=3):
        s, e, first = word_spans(data, off)
        h = span_hashes(data, s, e)
        hashes += [h[first[i]:first[i + 1]].tolist() for i in range(len(off) - 1)]
    a, b = hashes[0]
    assert hashes[2] == [b, a] and hashes[1] == hashes[3] == [] and hashes[5] == [b] and hashes[4] not in ([a], [b])


def test_span_hashes_do_not_depend_on_the_blocks(monkeypatch):
    from mathgrade.llm import wordbytes as wb
    data = np.frombuffer(("some words " * 40 + "averylongword" * 20 + " end").encode(), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    whole = span_hashes(data, s, e)
    monkeypatch.setattr(wb, "PIECE_BYTES", 16)
    assert (span_hashes(data, s, e) == whole).all() and len(span_hashes(data, s[:0], e[:0])) == 0
