"""Phrase collocations by set-oriented mining over sorted occurrence relations.

An occurrence relation of length k holds, per language, where each phrase of k words stands. It is kept in blocks of
whole texts, a row each: ``step`` (distance of each occurrence from the one before; words of a piece are 1 apart, pieces
2), ``item`` and ``phrases`` (what ``item`` counts into), packed as one binary: as arrays they cost the JVM several copies
of megabytes. Rows of a block are in order of position, and a block holds
whole pieces, so the merge-join "same piece, adjacent position" needs no shuffle: an occurrence joins the next one in
order if it is 1 further.

Round k: the relation of length k - 1 without infrequent groups is merge-joined with itself at adjacent positions, its
groups are counted (per block first, then by (language, phrase)), and frequent groups are kept. The relation of words
and the reduced relation of each length are stored; a longer relation is derived from the stored one, never before the
semi-join with the frequent groups of the length before. That semi-join takes a bit map of fixed size: it drops only
infrequent groups, and those it lets through by chance are dropped by the next count, which is exact.

Scores are exact: products are decimals of 38 digits (counts up to 5 * 10^15).

Definitions for odd input. A null language is ``und``, a null or empty text has no words. Repeated rows count each. Extra
columns are ignored. An empty table, or one without a frequent phrase, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import lowest, rows_per_batch, salted_join, stored, trimmed, wide_rows
from .wordbytes import LOWER_AZ, SEPARATOR, mix64, pieces, span_hashes, word_spans

#: Fewest occurrences of a phrase, most words of it, and rows of the result per language.
LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: A longer phrase replaces a part of it when it makes at least this share of the part's occurrences.
SHARE_NUM, SHARE_DEN = 50, 100
#: Bytes of text in a block (a longer text makes a block of its own).
BLOCK_BYTES = 1 << 20
#: Texts (and about so many bytes of them), and blocks, of an Arrow batch.
TEXTS_PER_BATCH, BYTES_PER_BATCH, BLOCKS_PER_BATCH = 2000, 8 << 20, 2
#: Bytes of a row group of a stored relation, and of a task that counts its phrases. A task's counts of longer phrases grow nearly
#: as its text, to many times its bytes.
GROUP_BYTES = 4 << 20
#: Bits of the map of frequent groups (8 MB).
FILTER_BITS = 1 << 26

#: ``n`` counts the occurrences of a block.
RELATION = "lang string, n long, block binary"
_PACKED = pa.schema([("step", pa.list_(pa.int32())), ("item", pa.list_(pa.int32())), ("phrases", pa.list_(pa.string()))])
_BYTES = LOWER_AZ.copy()
_BYTES[list(b".,;:!?\x0b\x0c\r")] = 10  # every end of a piece as \n
_BYTES[9] = 32


def _block(lang: str, at: np.ndarray, item: np.ndarray, phrases: pa.Array) -> pa.RecordBatch:
    step = np.diff(at, prepend=0).astype(np.int32)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(pa.list_(kind))
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(
            [one(pa.array(step), pa.int32()), one(pa.array(item.astype(np.int32)), pa.int32()), one(phrases, pa.string())], schema=_PACKED))
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([len(at)], pa.int64()),
                                       pa.array([packed.getvalue().to_pybytes()], pa.binary())], ["lang", "n", "block"])


def _words_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(positions, items, words) of each block of texts."""
    for _, _, data, off in pieces(column, BLOCK_BYTES):
        data = _BYTES[data]
        starts, ends, first = word_spans(data, off)
        if not len(starts):
            continue
        piece = np.cumsum(data == 10)[starts] + np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[0]) != 0)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        chars = data[~SEPARATOR[data]]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.tobytes())])
        coded = words.dictionary_encode()
        yield at, coded.indices.to_numpy(), coded.dictionary.cast(pa.string())


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            column = batch.column("text").take(pa.array(np.flatnonzero(codes == i)))
            for at, item, words in _words_of(column):
                yield _block(lang, at, item, words)


def _places(lang: str, phrases: pa.Array, n_bits: int) -> np.ndarray:
    """Places of (language, phrase) in a map of ``n_bits``."""
    flat = phrases.cast(pa.large_binary())
    off = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    h = span_hashes(data, off[:-1] - off[0], off[1:] - off[0])
    key = span_hashes(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))
    return mix64(h + key[0]) % np.uint64(n_bits)


def _group_places(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                p = _places(lang, batch.column("phrase").take(pa.array(np.flatnonzero(codes == i))), n_bits)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64))], ["place"])
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = pa.ipc.open_stream(batch.column("block")[i].as_buffer()).read_next_batch()
            step, item, phrases = (block.column(c)[0].values for c in _PACKED.names)
            yield batch.column("lang")[i].as_py(), np.cumsum(step.to_numpy(), dtype=np.int64), item.to_numpy(), phrases


def _semi_join(lang: str, at: np.ndarray, item: np.ndarray, phrases: pa.Array, bits: np.ndarray):
    """A block without the occurrences of groups that the map of frequent groups lacks."""
    stays = bitmaps.has(bits, _places(lang, phrases, 8 * len(bits)))
    number = np.cumsum(stays) - 1
    mask = stays[item]
    return at[mask], number[item[mask]], phrases.filter(pa.array(stays))


def _merge_join(at: np.ndarray, item: np.ndarray, phrases: pa.Array):
    """Occurrences one word longer: those that the next occurrence in order follows at distance 1."""
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    pair = item[here].astype(np.int64) * len(phrases) + item[here + 1]
    kinds, longer = np.unique(pair, return_inverse=True)
    width = max(1, len(phrases))
    head, tail = phrases.take(pa.array(kinds // width)), phrases.take(pa.array(kinds % width))
    last = pc.replace_substring_regex(tail, "^(?s:.*) ", "")
    return at[here], longer, pc.binary_join_element_wise(head, last, " ")


def _longer(bits):
    """The relation one word longer than the stored one, semi-joined with the frequent groups of its own length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, own = bits.value
        for lang, *block in _rows(batches):
            block = _semi_join(lang, *_merge_join(*_semi_join(lang, *block, shorter)), own)
            if len(block[0]):
                yield _block(lang, *block)
    return run


def _counted(bits):
    """Group counts of each block: of the relation itself, or with ``bits`` of the one a word longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, *block in _rows(batches):
            if bits is not None:
                block = _merge_join(*_semi_join(lang, *block, bits.value[0]))
            at, item, phrases = block
            if len(at):
                n = np.bincount(item, minlength=len(phrases))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(n)],
                                                 ["lang", "phrase", "f"])
    return run


def frequent(counts: DataFrame, least: int, words: int) -> DataFrame:
    groups = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(groups.withColumn("words", F.lit(words)), "frequent")


def mine(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS,
         filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, words) of all frequent phrases, and (lang, n) with the number of words."""
    sc = docs.sparkSession.sparkContext
    held = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH, BYTES_PER_BATCH):
        relation = stored(held.mapInArrow(trimmed(_tokens), RELATION), "occurrences-1", **wide_rows(GROUP_BYTES))
    sizes = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    with rows_per_batch(docs.sparkSession, BLOCKS_PER_BATCH, split=GROUP_BYTES):
        found = [frequent(relation.mapInArrow(trimmed(_counted(None)), "lang string, phrase string, f long"), least, 1)]

    def bits(groups: DataFrame) -> np.ndarray:
        return bitmaps.collected(groups.mapInArrow(trimmed(_group_places(filter_bits)), "place long"), "place", filter_bits)

    maps = [bits(found[0])]
    for words in range(2, most_words + 1):
        shared = sc.broadcast(maps)
        longer = relation.mapInArrow(trimmed(_counted(shared)), "lang string, phrase string, f long")
        with rows_per_batch(docs.sparkSession, BLOCKS_PER_BATCH, split=GROUP_BYTES):
            found.append(frequent(longer, least, words))
        if words < most_words:
            maps = [maps[0], bits(found[-1])]
            with rows_per_batch(docs.sparkSession, BLOCKS_PER_BATCH):
                relation = stored(relation.mapInArrow(trimmed(_longer(sc.broadcast(maps))), RELATION), f"occurrences-{words}",
                                  **wide_rows(GROUP_BYTES))
            maps = [maps[1]]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out, sizes


def _cuts(most_words: int):
    """The two parts of every cut of a phrase after its first k words."""
    words = F.split("phrase", " ")
    part = lambda k, first, a, n: F.struct(
        F.lit(k).alias("k"), F.lit(first).alias("first"), F.array_join(F.slice(words, F.lit(a), n), " ").alias("part"))
    sides = [s for k in range(1, most_words)
             for s in (part(k, True, 1, F.lit(k)), part(k, False, k + 1, F.greatest(F.col("words") - k, F.lit(0))))]
    return F.filter(F.array(*sides), lambda s: s["k"] < F.col("words"))


def _inside(most_words: int):
    """The shorter phrases of two words or more inside a phrase."""
    words = F.split("phrase", " ")
    none = F.array().cast("array<string>")

    def of(n: int):
        every = F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda a: F.array_join(F.slice(words, a, F.lit(n)), " "))
        return F.when(F.col("words") > n, every).otherwise(none)

    return F.concat(none, *[of(n) for n in range(2, most_words)])


def score() -> Column:
    """floor(1000000 a a / (l r)) of a cut, without rounding."""
    return F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0)))"
                  " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most_words`` words."""
    groups, sizes = mine(docs, least, most_words)
    candidates = groups.filter("words > 1").withColumnRenamed("f", "a")
    sides = candidates.select("lang", "phrase", "a", F.explode(_cuts(most_words)).alias("s")).select("lang", "phrase", "a", "s.*")
    counts = groups.select("lang", F.col("phrase").alias("part"), F.col("f").alias("c"))
    met = salted_join(sides, counts, ["lang", "part"], F.col("phrase"), salts=16, how="inner")
    cut = met.groupBy("lang", "phrase", "a", "k") \
        .agg(F.max(F.when(F.col("first"), F.col("c"))).alias("l"), F.max(F.when(~F.col("first"), F.col("c"))).alias("r"))
    scored = cut.withColumn("score", score()).groupBy("lang", "phrase", "a") \
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.score", "low.l", "low.r")
    longer = candidates.select("lang", F.explode(_inside(most_words)).alias("phrase"), F.col("a").alias("f_longer")) \
        .groupBy("lang", "phrase").agg(F.max("f_longer").alias("f_longer"))
    left = scored.join(longer, ["lang", "phrase"], "left") \
        .filter(F.coalesce(SHARE_DEN * F.col("f_longer") < SHARE_NUM * F.col("a"), F.lit(True)))
    ranked = lowest(left, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.col("phrase"))
    return ranked.join(sizes, "lang").select("lang", F.col("pos").alias("rank"), "phrase", "a", "l", "r", "n", "score")
