"""Encoding against the tiktoken library, prefix tables against re-encoding."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from mathgrade.llm import byte_bpe

LINES = open(P.path(byte_bpe.VOCABULARY), "rb").read()
V = byte_bpe.Vocabulary.parse(LINES)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    kinds = ["abc etaoin", "éèüßñ ", "0123456789", "\n\t  ", "#$%&<|>endoftext", "日本語😀"]
    made = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(0, 200))) for _ in range(200)]
    return [None, "", " ", "a" * 3000, "<|endoftext|>", "\r\n\r\n", "The quick brown fox", "x" * 70 + " y", *made]


def test_equals_the_library(spark):
    rows = list(enumerate(texts())) + [(None, "twice"), (None, "twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = byte_bpe.encode(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (rows[r.doc_id][1] if r.doc_id is not None else "twice") or ""
        ids = LIBRARY.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pairs_fit_if_merging_gives_them():
    rng = random.Random(1)
    for _ in range(20_000):
        a, b = rng.randrange(3000), rng.randrange(3000 if rng.random() < 0.8 else 50_000)
        assert V.fits(a, b) == (V.merge(V.bytes_of[a] + V.bytes_of[b]) == [a, b])


@pytest.mark.parametrize("vocabulary", ["real", "overlaps"])
def test_appends_and_edits(vocabulary):
    v = V if vocabulary == "real" else byte_bpe.Vocabulary({bytes([i]): i for i in range(256)} | {b"aa": 256, b"ab": 257, b"aaab": 258, b"ba": 259, b"zzz": 300})
    rng = random.Random(2)
    table = byte_bpe.PrefixTable(v)
    for _ in range(150):
        part = bytes(rng.choice(b"aabz e\xc3\xa9") for _ in range(rng.randrange(0, 6)))
        if rng.random() < 0.5:
            want = table.text + part
            table.append(part)
        else:
            a = rng.randrange(len(table.text) + 1)
            b = rng.randrange(a, len(table.text) + 1)
            want = table.text[:a] + part + table.text[b:]
            table.replace(a, b, part)
        assert table.text == want and table.ids() == v.merge(want) and v.decode(table.ids()) == want


def test_remembered_matches_may_be_dropped(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    lines = b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in V.ranks.items())
    encode = byte_bpe.encoder(lines, P.PATTERN)
    sample = [t or "" for t in texts()[:60]]
    for a in range(0, 60, 7):
        assert encode(sample[a:a + 7]) == [np.array(LIBRARY.encode_ordinary(t), "<u4").tobytes() for t in sample[a:a + 7]]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "LONG_MATCHES", 7)
    encode = byte_bpe.encoder(LINES, P.PATTERN)
    for t in texts():
        assert encode([t or ""]) == [np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes()]


def test_empty(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
