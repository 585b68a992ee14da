"""Language models and the quality classifier: exact arithmetic, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mathgrade.llm import language_id as li
from mathgrade.llm import quality_model as qm

TEXTS = {"aa": ["the cat sat on the mat", "that hat is the cat's", "a cat and a rat"], "bb": ["le chat est là", "les rats et le chat"]}


def plain_kneser_ney(texts):
    """log2-free reference: a dictionary implementation of one language."""
    n = li.ORDER
    counts = [None] * (n + 1)
    full = Counter()
    for t in texts:
        codes, _ = li._codes([t])
        codes = codes.tolist()
        for i, c in enumerate(codes):
            if c != li.PAD:
                full[tuple(codes[i - n + 1:i + 1])] += 1
    counts[n] = full
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def plain_logp(counts, vocabulary, gram):
    if not gram:
        return 1 / vocabulary
    c = counts[len(gram)]
    n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5
    context = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
    lower = plain_logp(counts, vocabulary, gram[1:])
    if not context:
        return lower
    total = sum(context.values())
    return max(context.get(gram, d) - d, 0) / total + d * len(context) / total * lower


def fitted():
    langs, grams, counts = [], [], []
    for k, texts in enumerate(TEXTS.values()):
        for g, c in plain_kneser_ney(texts)[li.ORDER].items():
            langs.append(k)
            grams.append(g)
            counts.append(c)
    return li.fit(list(TEXTS), np.array(langs), np.array(grams, np.uint32), np.array(counts))


def test_kneser_ney_equals_the_definition():
    model = fitted()
    plain = [plain_kneser_ney(t) for t in TEXTS.values()]
    vocabulary = len({g[-1] for p in plain for g in p[1]}) + 1
    for text in ["the chat", "xyz!", "Rat et cat", "", "123", "là"]:
        total, n = model.entropy([text])
        codes = li._codes([text])[0].tolist()
        at = [i for i, c in enumerate(codes) if c != li.PAD]
        assert n[0] == len(at)
        for k, p in enumerate(plain):
            want = -sum(math.log(plain_logp(p, vocabulary, tuple(codes[i - li.ORDER + 1:i + 1]))) for i in at)
            assert total[0, k] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_texts_are_scored_alone():
    model = fitted()
    texts = ["the cat", "", "le chat", "!!", "a\0b", "the cat"]
    together, n = model.entropy(texts)
    for i, t in enumerate(texts):
        alone, m = model.entropy([t])
        assert n[i] == m[0] and together[i] == pytest.approx(alone[0])


def test_long_texts_are_scored_in_parts(monkeypatch):
    model = fitted()
    texts = ["the cat et le rat " * 9, "x", "le chat"]
    whole = model.entropy(texts)
    monkeypatch.setattr(li, "PIECE_CHARS", 11)
    parts = model.entropy(texts)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    out = li.predict(docs, li.train(docs)).join(docs, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_documents(spark):
    rows = [(i, ["aa", "bb"][i % 2], TEXTS[["aa", "bb"][i % 2]][0], 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "aa", "", 1), (102, "bb", "123 ###", 1), (103, None, "the cat " * 20_000, 1), (None, "aa", "the cat", 1), (1, "bb", "le chat est là", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")
    model = li.train(docs)
    got = defaultdict(list)
    for r in li.predict(docs, model).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert [(got[i][0].lang_pred, got[i][0].score, got[i][0].rejected) for i in (100, 101, 102)] == [("und", 0.0, True)] * 3
    assert got[103][0].lang_pred == "aa" and got[None][0].lang_pred == "aa"
    kept = li.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = docs.filter("false")
    assert li.predict(none, li.train(none)).count() == 0
    assert {r.lang_pred for r in li.predict(docs, li.train(none)).collect()} == {"und"}


def test_noise_is_rejected(spark):
    rng = np.random.default_rng(0)
    words = ["the", "cat", "sat", "on", "mat", "rat", "hat", "and", "then", "that"]
    rows = [(i, "aa", " ".join(rng.choice(words, 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = li.train(docs, train_docs=60, calibration_docs=60)
    noise = spark.createDataFrame([(1, "x", "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 400)))], docs.schema)
    assert li.keep(noise, model).count() == 0 and li.keep(docs, model).count() == len(rows)


def test_noise_is_rejected_in_small_tables(spark):
    """Default parameters: a table that the counts would use up, a rare language, and one of a few documents."""
    rng = np.random.default_rng(0)
    words = {"aa": ["the", "cat", "sat", "on", "mat", "rat", "hat", "and", "then", "that"], "bb": ["le", "chat", "est", "là", "les", "rats", "noir", "jour"],
             "cc": ["der", "hund", "und", "die", "katze", "nicht", "ein", "wir"], "dd": ["uno", "gato", "y", "perro", "los", "dias", "que"]}
    rows = []
    for lang, size in (("aa", 200), ("bb", 60), ("cc", 12), ("dd", 3)):
        rows += [(len(rows) + i, lang, " ".join(rng.choice(words[lang], 60))) for i in range(size)]
    odd = [(k, "x", "".join(chr(c) for c in rng.integers(lo, hi, 400))) for k, (lo, hi) in enumerate([(0x4E00, 0x9000), (0x0430, 0x0450), (0xAC00, 0xD000)])]
    for langs in (["aa", "bb", "cc", "dd"], ["aa"], ["bb"], ["cc"], ["aa", "cc"], ["bb", "dd"]):
        docs = spark.createDataFrame([r for r in rows if r[1] in langs], "doc_id long, lang string, text string")
        model = li.train(docs)
        assert np.isfinite(model.limit).all()
        assert li.keep(spark.createDataFrame(odd, docs.schema), model).count() == 0, langs
        assert li.keep(docs, model).count() == docs.count(), langs


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(400):
        y = float(rng.random() < 0.5)
        at = np.array([0, 1 if y else 2, *rng.integers(10, 5000, 3)])
        examples.append((at, np.ones(5) * [1, 1, .3, .3, .3], y))
    w = qm.ftrl(examples)
    assert w[1] > 0.5 and w[2] < -0.5 and np.abs(w[10:]).max() < w[1]
    assert sum(((w[i] @ x) > 0) == (y == 1) for i, x, y in examples) >= 395


def test_features_do_not_depend_on_neighbours():
    texts = ["One two THREE!!", None, "", "a a a a a a a a", "One two THREE!!", "é&é " * 50]
    together = list(qm.features(pa.array(texts)))
    for t, (i, x) in zip(texts, together, strict=True):
        (j, y), = qm.features(pa.array([t], pa.string()))
        assert (i == j).all() and x == pytest.approx(y)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = qm.score(docs, qm.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(r.predicted == (r.score >= 0.3) for r in out)


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, ""), (None, "x"), (1, "again"), (4, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (9, 1, 0), (3, 7, 1)], "doc_id long, quality int, toxic int")
    out = qm.score(docs, qm.train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    unlearnt = qm.train(docs, labels.filter("false"))
    assert {r.score for r in qm.score(docs, unlearnt).collect()} == {0.5}
    assert qm.score(docs.filter("false"), unlearnt).count() == 0
