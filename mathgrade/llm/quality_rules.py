"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements
and one failure bit per rule. A policy is a versioned set of rules (a mask):
``apply_policy`` is a bitwise AND on the stored bits, and ``ablation`` counts
with bitwise aggregates what each rule alone decides, so changing a policy
never reads a text again.

Definitions for odd input. A null text has no words and fails ``few_words``.
Lines are split at \\n only, compared as they are (a \\r belongs to its line),
and count if they hold a word. Windows never cross documents. Rows are judged
one by one, so repeated rows and null ids get equal verdicts; extra columns
pass through ``keep``. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_and_text, texts, trimmed

from .wordbytes import mix64, pieces, span_hashes, window_hashes, word_spans

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutter"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True

#: Rule name -> SQL condition of failure over the measurements, in bit order. Integer arithmetic only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "upper_case": "100 * n_upper > 50 * n_letters",
    "stutter": "100 * n_stutter > 30 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "symbols", "repeated_lines")),
    Policy("v2", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "upper_case", "stutter")),
)}
CURRENT = "v2"


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True entries of a byte mask, by text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text in ``WINDOW``-word windows that occur twice or more in it."""
    n = len(words) - WINDOW + 1
    texts = len(first) - 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    text_of = np.repeat(np.arange(texts), np.diff(first))
    starts = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1:])
    keys = window_hashes(words, WINDOW)[starts] ^ mix64(text_of[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = starts[order[twice]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.cumsum(edge[:-1]) > 0, out=covered[1:])
    return covered[first[1:]] - covered[first[:-1]]


def _lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by text."""
    texts = len(off) - 1
    if not len(data):
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, begin)])
    worded = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end = begin[worded], end[worded]
    text = np.searchsorted(off, begin, "right") - 1
    keys = span_hashes(data, begin, end) ^ mix64(text.astype(np.uint64) + np.uint64(1))
    distinct = text[np.unique(keys, return_index=True)[1]]
    total = np.bincount(text, minlength=texts)
    return total, total - np.bincount(distinct, minlength=texts)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a string column."""
    parts: dict[str, list[np.ndarray]] = {m: [np.zeros(0, np.int64)] for m in MEASURES}
    for _, _, data, off in pieces(column):
        starts, ends, first = word_spans(data, off)
        words = span_hashes(data, starts, ends)
        sep = (data == 32) | ((data >= 9) & (data <= 13))
        lines, dups = _lines(data, off, starts)
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[first[:-1][first[:-1] < len(words)]] = False
        found = {"n_words": np.diff(first), "word_chars": _per_text(~sep & ((data & 0xC0) != 0x80), off),
                 "n_symbols": _per_text(_SYMBOL[data], off), "n_dup_lines": dups,
                 "n_repeat_words": _repeats(words, first), "n_lines": lines,
                 "n_upper": _per_text(_UPPER[data], off), "n_letters": _per_text(_LETTER[data], off),
                 "n_stutter": _per_text(again, first)}
        for m in MEASURES:
            parts[m].append(found[m])
    return {m: np.concatenate(v) for m, v in parts.items()}


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measure(batch.column("text"))
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in others] + [pa.array(found[m], pa.int64()) for m in MEASURES],
                                         [*others, *MEASURES])


def fail_bits() -> Column:
    """The failure bits of all rules from the measurements."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)])
    return rows.mapInArrow(trimmed(_measure_batches), schema).withColumn("fail_bits", fail_bits())


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return led.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed(BASE) & ~failed(policy)) \
        .withColumn("policy", F.lit(policy.version))


def ablation(led: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """By policy and rule: documents that fail the rule, and those that only this rule of the policy rejects.

    One pass over the ledger: rows are counted by their bits first (at most 2**rules groups)."""
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"),
                               F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"),
                               F.lit(p.mask).cast("long").alias("mask"))
                      for p in (policies or list(POLICIES.values())) for r in p.rules])
    rows = counts.select("fail_bits", "n", F.explode(rules).alias("p")).select("fail_bits", "n", "p.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"), F.sum("n").alias("n_docs"))


def keep(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, unchanged. The verdict is made beside the row, without a join."""
    rows = row_and_text(docs)
    schema = T.StructType([rows.schema["row"], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    led = rows.mapInArrow(trimmed(_measured_rows), schema).withColumn("fail_bits", fail_bits()).filter(~failed(policy))
    return led.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _measured_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measure(texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("row")] + [pa.array(found[m], pa.int64()) for m in MEASURES], ["row", *MEASURES])
