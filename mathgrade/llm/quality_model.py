"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

Features of a text are hashed n-grams of three word sequences: its lower-cased
words (1 and 2 words), the words' shapes (runs of lower case, upper case,
digits, other letters; punctuation as it is; 1 to 3 words), and recurrences (a
word equal to the one before; a 5-word window that occurred before). Each
family's counts are scaled to unit length. Training follows the regularised
leader, coordinate by coordinate (FTRL-proximal); a score is a sparse dot
product through a sigmoid.

Training reads a bounded sample of labelled rows: ``SHARDS`` shards by hash, at
most ``SHARD_DOCS`` rows each, whole texts. Each shard trains in its own task
and the weights are averaged. Every text of the table is scored whole.

Definitions for odd input. Null and empty texts have no features and score by
the bias. Rows with null or other labels than 0 and 1 are not learnt from; if a
document is labelled more than once, its lowest label counts. Without labels
all scores are 0.5. Rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_bucket, grouped, lowest, trimmed
from .wordbytes import LOWER_AZ, mix64, pieces, span_hashes, window_hashes, word_spans

BITS = 18
SHARDS = 8
SHARD_DOCS = 1_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
THRESHOLD = 0.3
REPEAT_WORDS = 5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
_FAMILY = [np.uint64(x) for x in (0x51ED270B27A3F0C5, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F)]


def _shape_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: byte classes without immediate repeats."""
    classes = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    inner = off[1:-1]
    keep[inner[inner < len(data)]] = True
    new = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=new[1:])
    starts, ends, _ = word_spans(classes[keep], new[off])
    return span_hashes(classes[keep], starts, ends)


def _unit(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one family's n-grams, scaled to unit length."""
    k = np.concatenate(keys)
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0)
    bucket, count = np.unique((k >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = count.astype(float)
    return bucket, value / np.sqrt((value * value).sum())


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text; the first bucket is the bias."""
    for a, b, raw, off in pieces(column):
        low = LOWER_AZ[raw]
        starts, ends, first = word_spans(low, off)
        words, shapes = span_hashes(low, starts, ends), _shape_hashes(raw, off)
        for i in range(b - a):
            w, s = words[first[i]:first[i + 1]], shapes[first[i]:first[i + 1]]
            idx, val = [np.zeros(1, np.int64)], [np.ones(1)]
            if len(w):
                again = w[1:] == w[:-1]
                runs = window_hashes(w, REPEAT_WORDS)
                recurrences = [(again.sum(), 1, max(len(again), 1)), (len(runs) - len(np.unique(runs)), 2, max(len(runs), 1))]
                for family, keys in enumerate(([w, window_hashes(w, 2)], [s, window_hashes(s, 2), window_hashes(s, 3)])):
                    at, v = _unit([mix64(k ^ _FAMILY[family]) for k in keys])
                    idx.append(at)
                    val.append(v)
                for n, kind, of in recurrences:
                    if n:
                        idx.append((mix64(np.array([kind], np.uint64) ^ _FAMILY[2]) >> np.uint64(64 - BITS)).astype(np.int64))
                        val.append(np.array([2.0 * n / of]))
            yield np.concatenate(idx), np.concatenate(val)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights after ``epochs`` passes over (buckets, values, label) in shuffled order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            at, x, y = examples[e]
            w = _weights(z[at], n[at], at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            root = np.sqrt(n[at])
            np.add.at(z, at, g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w)
            np.add.at(n, at, g * g)
    return _weights(z, n, np.arange(1 << BITS))


def _weights(z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    l1 = np.where(at == 0, 0.0, L1)
    return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _train_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in grouped(batches, "shard"):
        labels = shard.column("quality").to_pylist()
        w = ftrl([(i, x, float(y)) for (i, x), y in zip(features(shard.column("text")), labels, strict=True)])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array([shard.column("shard")[0].as_py()] * len(at), pa.int32())],
                                         ["bucket", "weight", "shard"])


def learnable(doc_id: Column) -> Column:
    return fraction_bucket(doc_id, 5) != 0


def train(docs: DataFrame, labels: DataFrame, shards: int = SHARDS, shard_docs: int = SHARD_DOCS) -> np.ndarray:
    """Averaged weights of the shards' models (2**BITS numbers)."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learnable(F.col("doc_id")))
    h = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    marked = marked.select("doc_id", F.col("quality").cast("int").alias("quality"), h.alias("h"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"))
    marked = lowest(marked, "shard", ["h", "doc_id", "quality"], shard_docs, F.col("doc_id"))
    marked = marked.groupBy("doc_id", "shard").agg(F.min("quality").alias("quality"))
    # at most shards * shard_docs rows
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    sample = sample.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").select("shard", "quality", F.col("text").cast("string").alias("text"))
    found = sample.mapInArrow(trimmed(_train_shards), "bucket long, weight double, shard int").toArrow()
    weights = np.zeros(1 << BITS)
    used = len(set(found.column("shard").to_pylist()))
    if used:
        np.add.at(weights, found.column("bucket").to_numpy(), found.column("weight").to_numpy() / used)
    return weights


def _score(weights: np.ndarray):
    small = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = small.astype(float)
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(w[i] @ x, -30, 30))) for i, x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(trimmed(_score(weights)), "doc_id long, score double")
    return out.withColumn("held_out", ~learnable(F.col("doc_id"))) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
