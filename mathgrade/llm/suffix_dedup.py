"""Removal of passages that an earlier document holds too, by sorting suffixes.

Texts are UTF-8 bytes. A byte goes if some string of ``LENGTH`` bytes covers it that also starts in a document with a
smaller id. Only suffixes that can have such a partner are sorted, and only to the depth ``LENGTH``.

1. Equal texts count once, as the one with the smallest id; its copies are removed whole.
2. Every window of ``LENGTH`` bytes names an anchor: the smallest hash of its strings of ``ANCHOR`` bytes. Equal windows
   have equal anchors, and neighbours mostly share theirs, so a text has an anchor for about 20 bytes. Short strings also
   repeat by chance, the more the larger the table; so what is counted over the texts is the anchor with the ``REACH`` bytes
   before it, or after it, of which every window holds one. Counts travel as sorted places, two bytes or so each. A
   Bloom filter of fixed size holds the contexts of two texts or more; a full one only lets more pass.
3. The windows of a marked context are sent, as one stretch of text, to the task of their anchor. There the suffixes that
   start at these windows are sorted deep-shallow: a multikey quicksort by characters of 8 bytes to the depth ``SHALLOW``,
   then blind (path-compressed) tries for the groups still equal there, which look at branching positions only. The tries
   of all groups of a task grow together, a level at a time. Suffixes equal to the depth ``LENGTH`` stand together; the
   smallest id among them decides.
4. An anchor of more than ``HOT`` texts isn't sent as it is: its equal stretches are merged first, with their smallest
   id. If more than ``HOT`` different stretches are left, its windows are grouped one by one by Spark, which holds none
   of them together.

All hashes only decide what is compared, except that texts and merged stretches are told apart by 128-bit digests.

Definitions for odd input. Null and empty texts have no bytes. A null id counts as larger than all others. Rows that
share an id don't remove from each other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import grouped, salted_join, stored, trimmed
from .wordbytes import BYTE_TABLE, pieces, sliding, string_hashes

LENGTH, ANCHOR, SHALLOW = 50, 16, 24
#: Bytes of an anchor's context on one side.
REACH = (LENGTH - ANCHOR) // 2
#: Texts of an anchor, or stretches of it, that one task takes.
HOT = 20_000
#: Bits of the filter of contexts (64 MB), of the map of hot anchors and of the map of texts.
CONTEXT_BITS, HOT_BITS, TEXT_BITS = 1 << 29, 1 << 22, 1 << 25
#: Bits of a place that a context or an anchor is counted by; the first ``PART`` of them name the part of the filter.
PLACE, PART = 36, 12
#: Factors of a place's bits in its part of the filter.
PROBES = 1, 0x9E3779B1, 0x85EBCA6B
#: Places that a task sorts at a time.
HELD = 1 << 21
#: Windows that are hashed at a time, and windows of one stretch.
SEGMENT, STRETCH = 1 << 19, 64
#: Bits of a position in a segment.
POSITION = 20
#: Copies of a text beyond which its rows are spread over tasks.
MANY = 1000
#: Stands for a null id.
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, number of windows, anchor, context, text) of the runs of windows with one place of their anchor and
    one side of its context, in a piece of texts. Of equal strings in a window the first is the anchor."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for a in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = BYTE_TABLE[data[a:a + SEGMENT + LENGTH - 1]]
        low = string_hashes(part, ANCHOR) >> np.uint64(POSITION) << np.uint64(POSITION)
        low = sliding(low | np.arange(len(low), dtype=np.uint64), LENGTH - ANCHOR + 1, np.minimum)
        at = np.arange(a, a + len(low))
        whole = at + LENGTH <= off[owner[at] + 1]
        at, low = at[whole], low[whole]
        if not len(at):
            continue
        own, place = owner[at], (low & np.uint64((1 << POSITION) - 1)).astype(np.int64)
        before = at - a + REACH <= place
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (before[1:] != before[:-1]) | (own[1:] != own[:-1])])
        first = np.flatnonzero(new)
        place, before = place[first], before[first]
        context = string_hashes(part, ANCHOR + REACH)[place - REACH * before] ^ before.astype(np.uint64) << np.uint64(63)
        yield at[first], np.diff(np.append(first, len(at))), low[first] >> np.uint64(POSITION), context, own[first]


def _context_place(context: np.ndarray) -> np.ndarray:
    return context >> np.uint64(64 - PLACE)


def _anchor_place(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(64 - POSITION - PLACE)


def _once(own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The places of each text, once."""
    return np.unique(own.astype(np.uint64) << np.uint64(PLACE) | place) & np.uint64((1 << PLACE) - 1)


def _sent(kind: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, places): the sorted places of each part as differences, their low bytes first."""
    place = np.sort(np.concatenate(held))
    part = (place >> np.uint64(PLACE - PART)).astype(np.int32)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    step = np.diff(place, prepend=np.uint64(0))
    step[begin] = place[begin] & np.uint64((1 << PLACE - PART) - 1)
    planes = np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    ends = [*begin[1:].tolist(), len(place)]
    rows = [planes[a:b].T.tobytes() for a, b in zip(begin.tolist(), ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), kind, np.int32)), pa.array(part[begin]), pa.array(rows, pa.binary())],
                                     ["kind", "part", "places"])


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of anchors (kind 0) and contexts (kind 1) of each text, once per segment of it."""
    held: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        for _, _, data, off in pieces(batch.column("text")):
            for _, _, low, context, own in anchors(data, off):
                for kind, place in enumerate((_anchor_place(low), _context_place(context))):
                    held[kind].append(_once(own, place))
                    if sum(map(len, held[kind])) >= HELD:
                        yield from _sent(kind, held[kind])
                        held[kind] = []
    for kind, places in enumerate(held):
        if places:
            yield from _sent(kind, places)


def _probes(place: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the bits of a context in its part of the filter."""
    rest, size = (1 << PLACE - PART) - 1, CONTEXT_BITS >> PART
    for factor in PROBES:
        yield ((place & np.uint64(rest)) * np.uint64(factor) & np.uint64(rest)) // np.uint64((rest + 1) // size)


def _repeated(hot: int):
    """Rows (kind, part, bits) from rows sorted by kind and part: a part of the filter, or the places of hot anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = (pa.RecordBatch.from_arrays([pc.add(pc.multiply(b.column("kind"), 1 << PART), b.column("part")), b.column("places")], ["key", "places"])
                 for b in batches)
        for rows in grouped(keyed, "key"):
            steps = [np.frombuffer(x, np.uint8).reshape(3, -1).astype(np.uint64) for x in rows.column("places").to_pylist()]
            place = np.concatenate([np.cumsum(x[0] | x[1] << np.uint64(8) | x[2] << np.uint64(16)) for x in steps])
            place, n = np.unique(place, return_counts=True)
            kind, part = divmod(rows.column("key")[0].as_py(), 1 << PART)
            place = place[n > (1 if kind else hot)]
            if not len(place):
                continue
            if kind:
                bits = np.zeros(CONTEXT_BITS >> PART, bool)
                for at in _probes(place):
                    bits[at] = True
                found = np.packbits(bits, bitorder="little")
            else:
                found = place | np.uint64(part << PLACE - PART)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                                             ["kind", "part", "bits"])
    return run


def _hot_place(place: np.ndarray) -> np.ndarray:
    return place % np.uint64(HOT_BITS)


def repeated(texts: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of contexts that two texts share, and the map of anchors of more than ``hot`` texts."""
    sent = texts.select("text").mapInArrow(trimmed(_place_rows), "kind int, part int, places binary")
    found = sent.repartition("kind", "part").sortWithinPartitions("kind", "part") \
        .mapInArrow(trimmed(_repeated(hot)), "kind int, part int, bits binary")
    contexts, very = np.zeros(CONTEXT_BITS >> 3, np.uint8), np.zeros(HOT_BITS >> 3, np.uint8)
    size = CONTEXT_BITS >> PART + 3
    for row in stored(found, "contexts").toLocalIterator():
        if row["kind"]:
            contexts[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
        else:
            place = _hot_place(np.frombuffer(row["bits"], np.uint64))
            np.bitwise_or.at(very, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return contexts, very


def _shared(contexts: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which contexts are in the filter."""
    place = _context_place(context)
    base = (place >> np.uint64(PLACE - PART)) * np.uint64(CONTEXT_BITS >> PART)
    mine = np.ones(len(context), bool)
    for at in _probes(place):
        mine[mine] = bitmaps.has(contexts, (base + at)[mine])
    return mine


def _stretches(maps, hot: bool):
    """The stretches of text whose contexts are in the filter of repeated ones, those of hot anchors or the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, very = maps.value
        for batch in batches:
            for i, _, data, off in pieces(batch.column("text")):
                for at, n, low, context, own in anchors(data, off):
                    mine = _shared(contexts, context)
                    mine &= bitmaps.has(very, _hot_place(_anchor_place(low))) == hot
                    at, n, low, own = at[mine], n[mine], low[mine], own[mine]
                    if not len(at):
                        continue
                    new = np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]) | (at[1:] != (at + n)[:-1])])
                    first = np.flatnonzero(new)
                    share = (at - np.repeat(at[first], np.diff(np.append(first, len(at))))) // STRETCH
                    new[1:] |= share[1:] != share[:-1]
                    first = np.flatnonzero(new)
                    at, n, low, own = at[first], np.add.reduceat(n, first) + LENGTH - 1, low[first], own[first]
                    ends = np.cumsum(n)
                    chars = data[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    text = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.tobytes())])
                    rows = pa.array(own + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(low.view(np.int64)), text, batch.column("low").take(rows), batch.column("key").take(rows),
                         pa.array(at - off[own])], ["anchor", "stretch", "low", "key", "at"])
    return run


def _parted(order: np.ndarray, group: np.ndarray, key: np.ndarray):
    """The groups in order of ``key``, parted by it: (places in ``order`` that stay, group). What is alone in its group
    is settled and goes."""
    o = np.lexsort((key, group))
    g, k = group[o], key[o]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
    shared = ~(new & np.append(new[1:], True))
    return o[shared], (np.cumsum(new) - 1)[shared]


def equal_suffixes(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, group): the suffixes of ``buffer`` at ``starts`` that equal another one to the depth ``LENGTH``; equal ones
    share a group and stand together."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort: a character, then the next one inside each group
        if len(order):
            o, group = _parted(order, group, eight[starts[order] + depth].copy().view(">u8").ravel().astype(np.uint64))
            order = order[o]
    rows = np.lib.stride_tricks.sliding_window_view(buffer, LENGTH - SHALLOW)[starts[order] + SHALLOW]
    out, n = [], 0
    while len(order):  # blind tries: each group branches where its first member and any other differ first
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(group)))
        differ = rows != np.repeat(rows[begin], size, axis=0)
        where = np.where(differ.any(1), differ.argmax(1), LENGTH - SHALLOW)
        branch = np.minimum.reduceat(where, begin)
        number = np.repeat(np.arange(len(begin)), size)
        leaf = (branch == LENGTH - SHALLOW)[number]
        out.append((order[leaf], number[leaf] + n))
        n += len(begin)
        order, rows, number = order[~leaf], rows[~leaf], number[~leaf]
        if len(order):
            o, group = _parted(order, number, rows[np.arange(len(rows)), branch[number]])
            order, rows = order[o], rows[o]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([g for _, g in out])


def _hits(stretch: pa.Array, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end) of the bytes of stretches that windows cover which a smaller ``low`` holds too."""
    off = np.frombuffer(stretch.buffers()[1], np.int32, len(stretch) + 1, stretch.offset * 4).astype(np.int64)
    buffer = np.frombuffer(stretch.buffers()[2], np.uint8)[off[0]:off[-1]]
    off -= off[0]
    n = np.diff(off) - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + off[owner]
    suffix, group = equal_suffixes(buffer, starts)
    if not len(suffix):
        return suffix, suffix, suffix
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(low[owner[suffix]], begin), np.diff(np.append(begin, len(group))))
    hit = np.sort(suffix[least < low[owner[suffix]]])
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
    first, last = hit[new], hit[np.append(new[1:], True)]
    own = owner[first]
    return own, starts[first] - off[own], starts[last] - off[own] + LENGTH


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole anchors, of about a batch or more; an anchor has at most ``HOT`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("anchor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column("anchor")[held[-1].num_rows - 1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held, batch = [], batch.slice(cuts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed bytes (key, start, end) of texts, from the stretches of whole anchors."""
    for rows in _chunks(batches):
        own, start, end = _hits(rows.column("stretch").combine_chunks(), rows.column("low").to_numpy())
        if len(own):
            at = rows.column("at").to_numpy()[own]
            yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(own)).combine_chunks(), pa.array(at + start), pa.array(at + end)],
                                             ["key", "start", "end"])


def _cover_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed bytes (anchor, id, start, end) inside merged stretches."""
    for rows in _chunks(batches):
        own, start, end = _hits(rows.column("stretch").combine_chunks(), rows.column("low").to_numpy())
        if len(own):
            mine = rows.select(["anchor", "id"]).take(pa.array(own)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(start), pa.array(end)], ["anchor", "id", "start", "end"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, i, text, low in zip(*[batch.column(c).to_pylist() for c in ("anchor", "id", "stretch", "low")], strict=True):
            n = len(text) - LENGTH + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([anchor] * n, pa.int64()), pa.array([i] * n, pa.binary()), pa.array(range(n), pa.int64()),
                 pa.array([text[a:a + LENGTH] for a in range(n)], pa.binary()), pa.array([low] * n, pa.int64())],
                ["anchor", "id", "start", "window", "low"])


def _hot_spans(rows: DataFrame, hot: int) -> DataFrame:
    """Removed bytes (key, start, end) of the stretches of hot anchors."""
    rows = stored(rows.withColumn("id", F.unhex(F.md5("stretch"))), "hot-stretches")
    merged = stored(rows.groupBy("anchor", "id").agg(F.min("low").alias("low"), F.first("stretch").alias("stretch")), "merged")
    crowded = stored(merged.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "crowded")
    few = merged.join(crowded, "anchor", "left_anti")
    found = few.repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(trimmed(_cover_merged), "anchor long, id binary, start long, end long")
    if not crowded.isEmpty():
        windows = merged.join(crowded, "anchor", "left_semi") \
            .mapInArrow(trimmed(_single_windows), "anchor long, id binary, start long, window binary, low long")
        least = windows.groupBy("window").agg(F.min("low").alias("least"))
        found = found.union(salted_join(windows, least, ["window"], F.col("id"), how="inner").filter("least < low")
                            .select("anchor", "id", "start", (F.col("start") + LENGTH).alias("end")))
    spans = found.groupBy("anchor", "id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    known = merged.select("anchor", "id", F.col("low").alias("least"), F.octet_length("stretch").cast("long").alias("size")) \
        .join(spans, ["anchor", "id"], "left")
    met = salted_join(rows.select("anchor", "id", "low", "key", "at"), known, ["anchor", "id"], F.col("key"), how="inner")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    return met.select("key", "at", F.explode(F.when(F.col("low") > F.col("least"), whole).otherwise(F.col("spans"))).alias("s")) \
        .select("key", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans (key, found) of each text in order, those that meet made one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("found")
        n = found.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        base = row << 40  # keeps the rows apart; a text has fewer than 2^31 bytes
        start, end = (x.to_numpy() + base for x in found.flatten().flatten())
        o = np.argsort(start, kind="stable")
        start, end = start[o], np.maximum.accumulate(end[o])
        first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        base = row[first] << 40
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int32)
        one = pa.StructArray.from_arrays([pa.array(start[first] - base), pa.array(end[np.append(first[1:], len(end)) - 1] - base)], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), one).cast(kind)], ["key", "found"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed spans."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans, kept = [], []
        for text, found, whole in zip(*[batch.column(c).to_pylist() for c in ("text", "found", "whole")], strict=True):
            data, merged = text.encode(), []
            if whole and len(data) >= LENGTH:
                merged = [[0, len(data)]]
            elif not whole:
                for x in sorted(found or (), key=lambda x: x["start"]):
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["start"], x["end"]])
            spans.append([dict(start=a, end=b) for a, b in merged])
            edges = [0, *[e for span in merged for e in span], len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "spans", "kept"])


def _text_place(key: str):
    return F.pmod(F.xxhash64(key), F.lit(TEXT_BITS))


def distinct_texts(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(low, key, text): each text of at least ``LENGTH`` bytes once, with its smallest id. Only texts with copies are shuffled."""
    shared = stored(sizes.filter("n > 1").select("key", "low"), "shared")
    docs = bitmaps.marked(docs.filter(F.col("n_bytes") >= LENGTH), bitmaps.bit_rows(shared.select(_text_place("key").alias("p")), "p"),
                          _text_place("key"), "_maybe")
    alone = docs.filter(~F.col("_maybe")).select(F.col("order").alias("low"), "key", "text")
    others = docs.filter("_maybe").join(sizes.select("key", F.col("low").alias("order")), ["key", "order"], "left_semi") \
        .dropDuplicates(["key"]).select(F.col("order").alias("low"), "key", "text")
    return alone.union(stored(others, "one-of-copies"))


def removed_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, start, end) of the removed bytes of distinct texts (low, key, text); they may overlap."""
    maps = repeated(texts, hot)
    has_hot = bool(maps[1].any())
    shared = texts.sparkSession.sparkContext.broadcast(maps)
    schema = "anchor long, stretch binary, low long, key binary, at long"
    rows = texts.mapInArrow(trimmed(_stretches(shared, False)), schema)
    spans = rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(_cover), "key binary, start long, end long")
    if has_hot:
        spans = spans.union(_hot_spans(texts.mapInArrow(trimmed(_stretches(shared, True)), schema), hot))
    return spans


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for each row the removed spans (start, end), in order, and the bytes left."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("order"), F.octet_length("text").cast("long").alias("n_bytes"),
                F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"))
    sizes = stored(docs.groupBy("key").agg(F.min("order").alias("low"), F.count(F.lit(1)).alias("n")), "texts")
    spans = removed_spans(distinct_texts(docs, sizes), hot).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    spans = stored(spans.mapInArrow(trimmed(_merged), "key binary, found array<struct<start: long, end: long>>"), "spans")
    info = sizes.join(spans, "key", "left").filter("n > 1 or found is not null").select("key", "low", "found")
    info = stored(info, "touched")
    rows = bitmaps.marked(docs, bitmaps.bit_rows(info.select(_text_place("key").alias("p")), "p"), _text_place("key"), "_maybe")
    many = bitmaps.bit_rows(sizes.filter(F.col("n") > MANY).select(_text_place("key").alias("p")), "p")
    maybe, info = (bitmaps.marked(x, many, _text_place("key"), "_many") for x in (rows.filter("_maybe"), info))
    met = salted_join(maybe, info, ["key"], F.col("order"), many="_many")
    cut = met.select("doc_id", "n_bytes", "text", "found", F.coalesce(F.col("order") > F.col("low"), F.lit(False)).alias("whole")) \
        .mapInArrow(trimmed(_cut), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    none = F.array().cast("array<struct<start: long, end: long>>")
    return cut.union(rows.filter(~F.col("_maybe")).select("doc_id", "n_bytes", none.alias("spans"), F.col("text").cast("binary").alias("kept")))
