"""Runs of periodic words: stretches in which the words ``q`` apart are identical.

A run is a maximal stretch with smallest period ``q`` and at least ``max(24, 3 q)`` words. Texts of a batch are laid out
as one sequence of word numbers with a unique separator after each text, so that every step below is one pass over the
batch.

Periods up to ``SHORT`` are found by direct lag scans. Longer ones are found scale by scale. The scale of the periods
``lo + 1 .. hi`` takes the minimizers of all windows of ``w`` consecutive ``hi``-word strings, with ``w`` chosen so that
two windows one period apart lie inside any run of the scale: they hold the same strings, so their minima repeat at period
distance. A string of ``hi >= q`` words recurs inside a run of period ``q`` at multiples of ``q`` only, so the two are
neighbours among the equal minimizers of the batch. Each such pair seeds an extension, word by word, to both sides; a
stretch that a divisor of the distance describes too is left to that divisor's scale. String hashes only seed: lengths
and periods are decided on the words (a run could be lost only to a collision of 64-bit hashes inside one batch).

Definitions for odd input. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows each
get their own result. Other columns are passed through unless they clash with ``runs``, ``best`` or ``collapsed``, which
replace them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, texts, trimmed
from .wordbytes import mix64, pieces, sliding, string_hashes

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this one are scanned directly.
SHORT = 8
#: A scale reaches from ``lo`` to 3/2 of it.
NUM, DEN = 3, 2

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "struct<start: long, length: long, period: long>"


def _minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of some window of ``w`` hashes."""
    low = sliding(hashes, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([pad, low, pad]), w, np.maximum) == hashes)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two equally long views."""
    at, step = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def _extend(x: np.ndarray, m: int, q: int) -> tuple[int, int]:
    """The longest stretch around position ``m`` (first word, end) whose words ``q`` apart are identical."""
    right = _agree(x[m:len(x) - q], x[m + q:])
    left = _agree(x[:m][::-1], x[q:m + q][::-1])
    return m - left, m + right + q


def _primitive(x: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether no proper divisor of ``q`` is a period of the stretch, which has the period ``q`` three times."""
    rest, p = q, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p <= rest else rest
            continue
        while rest % p == 0:
            rest //= p
        d = q // p
        if np.array_equal(x[s:e - d], x[s + d:e]):
            return False
    return True


def _long_enough(s: int, e: int, q: int) -> bool:
    return e - s >= max(LEAST_WORDS, LEAST_PERIODS * q)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, window) of every scale that a text of ``longest`` words can hold a run of."""
    lo = SHORT
    while LEAST_PERIODS * (lo + 1) <= longest:
        hi = max(lo + 1, lo * NUM // DEN)
        yield lo, hi, max(1, (LEAST_PERIODS - 1) * (lo + 1) - hi + 1)
        lo = hi


def find_runs(x: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of texts; text ``i`` has ``lengths[i]`` words and a separator."""
    out = []
    for q in range(1, min(SHORT, len(x) - 1) + 1):
        same = np.zeros(len(x) - q + 2, np.int8)
        same[1:-1] = x[:-q] == x[q:]
        turn = np.diff(same)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + q
        enough = ends - starts >= max(LEAST_WORDS, LEAST_PERIODS * q)
        for s, e in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            if _primitive(x, s, e, q):
                out.append((s, e - s, q))
    here, at, values = x, np.arange(len(x)), None
    texts_left = np.repeat(lengths, lengths + 1)
    for lo, hi, w in scales(int(lengths.max()) if len(lengths) else 0):
        fits = texts_left >= LEAST_PERIODS * (lo + 1)
        if values is None or not fits.all():  # texts too short for the scale go
            here, at, texts_left = here[fits], at[fits], texts_left[fits]
            values = mix64(here.astype(np.uint64) + np.uint64(1))
        if len(here) < hi + w - 1:
            break
        hashes = string_hashes(values, hi)
        sel = _minimizers(hashes, w)
        order = np.argsort(hashes[sel], kind="stable")
        h, p = hashes[sel][order], sel[order]
        gap = np.diff(p)
        seed = np.flatnonzero((h[1:] == h[:-1]) & (gap > lo) & (gap <= hi))
        known: dict[int, tuple[int, int]] = {}
        for m, q in sorted(zip(p[seed].tolist(), gap[seed].tolist(), strict=True)):
            if m + q < known.get(q, (0, -1))[1]:
                continue
            s, e = known[q] = _extend(here, m, q)
            if _long_enough(s, e, q) and _primitive(here, s, e, q):
                out.append((int(at[s]), e - s, q))
    return out


def _of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch)
        for a, b, data, off in pieces(column):
            raw, cuts = data.tobytes(), off.tolist()
            numbers: dict[bytes, int] = {}
            words = [raw[s:e].split() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]  # bytes split at the separators of WORD
            parts = []
            for i, ws in enumerate(words):
                parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)))
                parts.append(np.array([-1 - i]))
            lengths = np.array([len(ws) for ws in words])
            first = np.concatenate([[0], np.cumsum(lengths + 1)])
            found: dict[int, list[tuple[int, int, int]]] = {}
            for s, n, q in find_runs(np.concatenate(parts), lengths):
                i = int(np.searchsorted(first, s, "right")) - 1
                found.setdefault(i, []).append((s - int(first[i]), n, q))
            runs, best, collapsed = [], [], []
            for i, ws in enumerate(words):
                mine = sorted(found.get(i, ()), key=lambda r: (r[0], r[2]))
                top = None
                keep = np.ones(len(ws), bool)
                for s, n, q in mine:
                    keep[s + q:s + n] = False
                    if top is None or n * top[2] > top[1] * q:
                        top = (s, n, q)
                runs.append([dict(start=s, length=n, period=q) for s, n, q in mine])
                best.append(top and dict(start=top[0], length=top[1], period=top[2]))
                collapsed.append(b" ".join(ws if not mine else [w for w, k in zip(ws, keep, strict=True) if k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(a, b - a), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["row", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period), ``best`` (the run of the greatest length / period; ties: smallest
    start, then period; null without runs) and ``collapsed``: the words joined by one space, without those that any run
    contains after its first period."""
    rest = [c for c in docs.columns if c not in ("runs", "best", "collapsed")]
    row = docs.select(F.struct(*[docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in rest]).alias("row"))
    kind = row.schema["row"].dataType.simpleString()
    found = row.mapInArrow(trimmed(_of_batch), f"row {kind}, runs array<{RUN_DDL}>, best {RUN_DDL}, collapsed string")
    return found.select(*[F.col("row")[c].alias(c) for c in rest], "runs", "best", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which each tenth document, by the crc32 ``h`` of its id, is made periodic from word ``a`` on: with
    ``g = h // 10`` and n words, ``a = g % n`` and the period is ``1 + (n - a) // (3 + g % 8)``. A null id plants none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")

    # the one-element array names the words, so that they are cut once
    words = F.filter(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.size(w) > 0)
    text = F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.coalesce(F.get(F.transform(words, repeat), F.lit(0)), F.col("text")))
    return docs.withColumn("text", text.otherwise(F.col("text")))
