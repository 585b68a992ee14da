"""Near-duplicate groups by a chosen-path set similarity join.

Each document is its set of distinct 5-word shingles. ``COORDINATES`` minwise
tokens are drawn per set. A tree starts with all documents at its root; a node
chooses minwise coordinates by the hash of its path and its documents branch
by the tokens found there. Nodes of at most ``leaf`` documents are compared
exhaustively, larger ones branch again; ``TREES`` independent trees are grown.
Every node chooses two coordinates, so a pair at the threshold s = 0.75 stays
together in a node with probability at least f = 1 - (1 - s f)^2 = 0.889 per
tree whatever its depth, and is missed by all 8 trees with probability below
3e-8.

What a node compares are minwise signatures, with a bar (``SURE``) more than
four and a half standard deviations below the threshold. A node reports a
spanning forest, not its pairs. The forests' components are candidate
families: no link leaves a family. Inside a family links are then confirmed
exactly on full sets, by searches that stop once a set is reached, so a large
family needs no list of its pairs either.

Shingles are told apart by 64-bit hashes: two different shingles of a pair of
texts with n of them each are equal with a chance of about n^2 / 2^64 (2e-11
for 20,000 words).

Definitions for odd input. Null and empty texts have no shingles and link with
nothing. Rows that share a ``doc_id`` are one node. Rows with a null ``doc_id``
are nodes of their own, one for each text (by a 61-bit hash, above the largest
id, which must be below 2^61): they link like others, and links through them
count. Their component is the smallest id they reach, or null if they reach
none; of such a component one node is kept. Equal sets form one node from the
start. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import binary_matrix, grouped, salted_join, stored, to_binary, trimmed
from .components import connected_components
from .wordbytes import LOWER_AZ, mix64, pieces, span_hashes, window_hashes, word_spans

SHINGLE = 5
COORDINATES = 96
TREES = 8
BRANCHES = 2
LEAF = 200
#: A node with more documents than this is split by a Spark shuffle, a smaller one inside its task.
TASK_NODE = 20_000
MAX_DEPTH = 5
#: Equal coordinates, of 96, that make two sets of a node candidates (4.6 standard deviations below 72).
SURE = 52
#: A family with more sets, or more shingles, than this is linked block by block.
FAMILY_SETS = 4_000
FAMILY_SHINGLES = 6_000_000
#: Sets of a block, and blocks that share ``FAMILY_SHINGLES``. Blocks are dealt by hash: two of them, which meet in one
#: task, hold two thirds of it on average, so that uneven blocks stay below it too.
BLOCK, BLOCKS_SHARE = 1_000, 3
#: Bits of the map of family members, and of one row of it.
FILTER_BITS, MAP_BITS = 1 << 25, 1 << 15
NUM, DEN = 75, 100

_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The coordinates that the roots of the trees choose; deeper nodes choose by path.
_ROOT = _RNG.permutation(COORDINATES)[:TREES * BRANCHES].reshape(TREES, BRANCHES)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text of a string column."""
    for a, b, data, off in pieces(column):
        data = LOWER_AZ[data]
        starts, ends, first = word_spans(data, off)
        words = span_hashes(data, starts, ends)
        for i in range(b - a):
            w = words[first[i]:first[i + 1]]
            yield np.unique(window_hashes(w, min(SHINGLE, len(w)))) if len(w) else w


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of every coordinate, as its upper 32 bits."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 4096):  # keeps the product small for very long texts
        part = np.multiply.outer(_MULTIPLIERS, shingles[a:a + 4096])
        np.minimum(low, part.min(axis=1), out=low)
    return (mix64(low) >> np.uint64(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, sigs = [], [], []
        for s in shingle_sets(batch.column("text")):
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            counts.append(len(s))
            sigs.append(signature(s))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 to_binary(np.array(sigs))], ["doc_id", "n_shingles", "set_key", "sig"])


def _children(paths: np.ndarray, sigs: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """Path hashes of the children that rows of ``sigs`` go to by the tokens at ``coords`` (one row of
    coordinates per row, or one for all)."""
    tokens = np.take_along_axis(sigs, np.broadcast_to(coords, (len(sigs), coords.shape[-1])), 1).astype(np.uint64)
    return mix64(paths[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix64(tokens + coords.astype(np.uint64) * np.uint64(1 << 33)))


def _chosen(paths: np.ndarray) -> np.ndarray:
    """The coordinates that nodes choose by the hash of their path."""
    h = mix64(paths + np.uint64(0xD1B54A32D192ED03))
    first = h % np.uint64(COORDINATES)
    step = np.uint64(1) + (h >> np.uint64(32)) % np.uint64(COORDINATES - 1)
    return np.stack([first, (first + step) % np.uint64(COORDINATES)], 1).astype(np.int64)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First branching: every set goes to two children in each tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = binary_matrix(batch.column("sig"), np.uint32)
        keys = [_children(np.full(len(sigs), t + 1, np.uint64), sigs, _ROOT[t]) for t in range(TREES)]
        keys = np.concatenate(keys, 1)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))],
                                         ["path", "id"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Further branching of nodes too large for one task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
        keys = _children(paths, binary_matrix(batch.column("sig"), np.uint32), _chosen(paths))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))],
                                         ["path", "id"])


def _leaf_forest(ids: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars of the candidate graph of one small node."""
    m = len(ids)
    if m == 2:
        if ids[0] != ids[1] and int((sigs[0] == sigs[1]).sum()) >= SURE:
            return [(int(ids.max()), int(ids.min()))]
        return []
    order = np.argsort(ids, kind="stable")
    ids, sigs = ids[order], sigs[order]
    out, todo = [], np.arange(m)
    while len(todo) > 1:
        root, front = todo[0], [todo[0]]
        todo = todo[1:]
        while front and len(todo):
            near = (sigs[todo] == sigs[front.pop()]).sum(1) >= SURE
            if near.any():
                front.extend(todo[near])
                out.extend((int(i), int(ids[root])) for i in ids[todo[near]] if i != ids[root])
                todo = todo[~near]
    return out


def _grow(path: int, ids: np.ndarray, sigs: np.ndarray, leaf: int, depth: int) -> list[tuple[int, int]]:
    """The subtree below one node: compare, or branch by chosen tokens. A node still large at the deepest
    level shares ``MAX_DEPTH`` minwise tokens and becomes part of one family as it is."""
    if len(ids) <= leaf:
        return _leaf_forest(ids, sigs)
    if depth >= MAX_DEPTH:
        low = int(ids.min())
        return [(int(i), low) for i in ids if i != low]
    p = np.array([path], np.uint64)
    keys = _children(np.repeat(p, len(ids)), sigs, _chosen(p)[0])
    out = []
    for c in range(keys.shape[1]):
        order = np.argsort(keys[:, c], kind="stable")
        k = keys[order, c]
        cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                part = order[a:b]
                out += _grow(int(k[a]), ids[part], sigs[part], leaf, depth + 1)
    return out


def _compare(leaf: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        for node in grouped(batches, "path"):
            ids = node.column("id").to_numpy()
            pairs.update(_grow(node.column("path")[0].as_py() & 0xFFFFFFFFFFFFFFFF, ids,
                               binary_matrix(node.column("sig"), np.uint32), leaf, depth))
            if len(pairs) > 50_000:
                yield _edges(pairs)
                pairs = set()
        if pairs:
            yield _edges(pairs)
    return run


def _edges(pairs) -> pa.RecordBatch:
    e = np.array(list(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def candidate_edges(sets: DataFrame, leaf: int = LEAF, task_node: int = TASK_NODE) -> DataFrame:
    """Forest edges (u, v) between sets (id long, sig binary) that meet in a node of some tree."""
    rows = sets.mapInArrow(trimmed(_roots), "path long, id long")
    found: list[DataFrame] = []
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = salted_join(rows, sizes, ["path"], F.col("id"), how="inner")
        met = stored(met.join(sets, "id"), "nodes")
        small = met.filter(F.col("size") <= task_node).select("path", "id", "sig")
        found.append(stored(small.repartition("path").sortWithinPartitions("path", "id")
                            .mapInArrow(trimmed(_compare(leaf, depth)), "u long, v long").distinct(), "forest"))
        large = met.filter(F.col("size") > task_node)
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            low = large.groupBy("path").agg(F.min("id").alias("v"))
            found.append(salted_join(large.select("path", F.col("id").alias("u")), low, ["path"], F.col("u"), how="inner")
                         .filter("u <> v").select("u", "v").distinct())
            break
        rows = large.select("path", "id", "sig").mapInArrow(trimmed(_branch), "path long, id long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _linked(a: int, b: int, both: int) -> bool:
    return DEN * both >= NUM * (a + b - both)


class _Family:
    """Sets of one family with postings, searched for links of one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self._index(np.arange(len(sets)))

    def _index(self, alive: np.ndarray) -> None:
        """Postings of the sets still to be reached."""
        self.alive = np.zeros(len(self.sets), bool)
        self.alive[alive] = True
        self.left = self.indexed = len(alive)
        lens = self.sizes[alive]
        vals = np.concatenate([self.sets[i] for i in alive]) if len(alive) else np.zeros(0, np.uint64)
        owner = np.repeat(alive, lens)
        order = np.argsort(vals, kind="stable")
        self.owner = owner[order].astype(np.int32)
        self.vals, self.begin = np.unique(vals[order], return_index=True)
        self.begin = np.append(self.begin, len(vals))

    def reach(self, shingles: np.ndarray) -> np.ndarray:
        """Members still to be reached that link with ``shingles``; they count as reached then."""
        if not self.left:
            return np.zeros(0, np.int64)
        if self.left * 2 < self.indexed:
            self._index(np.flatnonzero(self.alive))
        at = np.searchsorted(self.vals, shingles)
        at[at == len(self.vals)] = 0
        at = at[self.vals[at] == shingles] if len(self.vals) else at[:0]
        lens = self.begin[at + 1] - self.begin[at]
        total = int(lens.sum())
        if not total:
            return np.zeros(0, np.int64)
        index = np.repeat(self.begin[at] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(total)
        both = np.bincount(self.owner[index], minlength=len(self.sets))
        hit = self.alive & (DEN * both >= NUM * (self.sizes + len(shingles) - both)) & (both > 0)
        found = np.flatnonzero(hit)
        self.alive[found] = False
        self.left -= len(found)
        return found


def family_links(ids: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Component (its smallest id) of each set of one family, by exact searches
    from each reached set among those not reached yet."""
    order = np.argsort(ids, kind="stable")
    fam = _Family([sets[i] for i in order])
    comp = np.empty(len(ids), np.int64)
    same: dict[int, int] = {}
    for i in range(len(order)):
        if not fam.alive[i]:
            continue
        fam.alive[i] = False
        fam.left -= 1
        front, root = [i], ids[order[i]]
        comp[order[i]] = root
        while front:
            for j in fam.reach(fam.sets[front.pop()]):
                comp[order[j]] = root
                front.append(int(j))
    # rows that share an id are one node: merge their components
    for i in order:
        a, b = _root(same, int(comp[i])), _root(same, int(ids[i]))
        if a != b and (ids[i] in same or (ids == ids[i]).sum() > 1):
            same[max(a, b)] = min(a, b)
    if same:
        comp = np.array([_root(same, int(c)) for c in comp], np.int64)
    return comp


def _root(parent: dict[int, int], x: int) -> int:
    while x in parent:
        x = parent[x]
    return x


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full shingle sets of family members, from their texts."""
    for batch in batches:
        blobs, held, start = [], 0, 0
        for i, s in enumerate(shingle_sets(batch.column("text"))):
            blobs.append(s.tobytes())
            held += len(blobs[-1])
            if held > 16 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("family").slice(start, len(blobs)), batch.column("id").slice(start, len(blobs)),
                     pa.array(blobs, pa.large_binary()).cast(pa.binary())], ["family", "id", "shingles"])
                blobs, held, start = [], 0, i + 1


def _link_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids_out: list[np.ndarray] = []
    comp_out: list[np.ndarray] = []
    for fam in grouped(batches, "family"):
        ids = fam.column("id").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in fam.column("shingles").to_pylist()]
        ids_out.append(ids)
        comp_out.append(family_links(ids, sets))
    if ids_out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(comp_out))],
                                         ["id", "component"])


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the sets of two blocks of a large family: each set of the second block that links with the
    first is linked to one partner per component already known, which keeps the output linear."""
    for pair in grouped(batches, "pair"):
        side = pair.column("side").to_numpy()
        ids, known = pair.column("id").to_numpy(), pair.column("known").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in pair.column("shingles").to_pylist()]
        left = np.flatnonzero(side == 0)
        out = set()
        label = {int(c): int(c) for c in np.unique(known)}
        for c in np.unique(known[left]):
            # a component's sets search those of the other block that are not joined with it yet
            mine = [i for i in left if known[i] == c]
            fam = _Family([sets[i] for i in range(len(sets)) if side[i] == 1 and _top(label, known[i]) != _top(label, c)])
            where = [i for i in range(len(sets)) if side[i] == 1 and _top(label, known[i]) != _top(label, c)]
            for i in mine:
                for j in fam.reach(sets[i]):
                    a, b = _top(label, known[where[j]]), _top(label, c)
                    if a != b:
                        label[max(a, b)] = min(a, b)
                        out.add((int(ids[i]), int(ids[where[j]])))
        if out:
            yield _edges({(max(a, b), min(a, b)) for a, b in out})


def _top(label: dict[int, int], c) -> int:
    c = int(c)
    while label[c] != c:
        c = label[c]
    return c


def _blocks(members: DataFrame, block: int, family_shingles: int) -> DataFrame:
    """``members`` with the number of blocks of their family, by sets and by shingles, and their own block."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles") / 8).alias("w"))
    number = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") * BLOCKS_SHARE / family_shingles)).cast("long")
    m = members.join(sizes.select("family", number.alias("blocks")), "family")
    return m.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))


def _link_large(members: DataFrame, block: int, family_shingles: int) -> DataFrame:
    """Exact components of families too large for one task.

    The family is cut into blocks; each block is linked inside one task first, which leaves few components.
    Then pairs of blocks are compared, only between sets of different components. A block meets each other block
    of its family once, in its own task; output is linear in the family."""
    m = stored(_blocks(members, block, family_shingles), "members")
    inner = m.withColumn("family", F.xxhash64("family", "block")).select("family", "id", "shingles")
    inner = stored(inner.repartition("family").sortWithinPartitions("family", "id")
                   .mapInArrow(trimmed(_link_families), "id long, component long").distinct(), "inner")
    known = m.join(inner.withColumnRenamed("component", "known"), "id")
    facing = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .filter("other <> block") \
        .select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
                (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "known", "shingles")
    links = facing.repartition("pair").sortWithinPartitions("pair", "side", "id") \
        .mapInArrow(trimmed(_link_blocks), "u long, v long")
    return connected_components(links.union(inner.select(F.col("id").alias("u"), F.col("component").alias("v"))))


def _maybe_in(docs: DataFrame, family: DataFrame) -> DataFrame:
    """``docs`` without most of those that are in no family, so that their texts aren't shuffled.

    A bit map of ``FILTER_BITS`` hashed ids (at most 4 MB, however many ids there are) is broadcast. Too many ids
    only fill the map and let more texts pass; the join that follows decides."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = family.select(place.alias("p")).groupBy((F.col("p") / MAP_BITS).cast("long").alias("_map")) \
        .agg(F.bitmap_construct_agg(F.col("p") % MAP_BITS).alias("_bits"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    met = docs.withColumn("_p", place % MAP_BITS).withColumn("_map", (place / MAP_BITS).cast("long")).join(F.broadcast(bits), "_map")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_p div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0).select(*docs.columns)


NULL_IDS = 1 << 61


def _nodes(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with a node id ``_node`` for every row, and the largest real id."""
    doc_id = F.col("doc_id").cast("long")
    top = docs.agg(F.max(doc_id)).first()[0] or 0
    own = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(NULL_IDS)) + F.lit(max(top, 0) + 1)
    return docs.withColumn("_node", F.coalesce(doc_id, own)), max(top, 0)


def _components(docs: DataFrame, leaf: int = LEAF, task_node: int = TASK_NODE, family_sets: int = FAMILY_SETS,
                family_shingles: int = FAMILY_SHINGLES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component) for every row of ``docs``, whose ids are not null."""
    base = stored(docs.mapInArrow(trimmed(_sketch), "doc_id long, n_shingles long, set_key binary, sig binary"), "sketches")
    groups = stored(base.filter("n_shingles > 0").groupBy("set_key")
                    .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "groups")
    sets = base.select(F.col("doc_id").alias("id"), "set_key", "n_shingles", "sig").join(groups.select("id", "set_key"), ["id", "set_key"], "left_semi")
    sets = stored(sets, "sets")
    edges = candidate_edges(sets.select("id", "sig"), leaf, task_node)
    family = connected_components(edges).withColumnRenamed("component", "family")
    weight = family.join(sets.select("id", "n_shingles"), "id").groupBy("family") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    large = weight.filter((F.col("n") > family_sets) | (F.col("w") > family_shingles)).select("family")
    members = _maybe_in(docs, family).join(family.withColumnRenamed("id", "doc_id"), "doc_id") \
        .select("family", F.col("doc_id").alias("id"), "text")
    members = members.mapInArrow(trimmed(_sets_of), "family long, id long, shingles binary")
    exact: DataFrame
    if large.isEmpty():
        exact = members.repartition("family").sortWithinPartitions("family", "id") \
            .mapInArrow(trimmed(_link_families), "id long, component long")
    else:
        members = stored(members, "members")
        large = stored(large, "large")
        exact = members.join(large, "family", "left_anti").repartition("family").sortWithinPartitions("family", "id") \
            .mapInArrow(trimmed(_link_families), "id long, component long") \
            .union(_link_large(members.join(large, "family", "left_semi"), block, family_shingles))
    exact = stored(exact.groupBy("id").agg(F.min("component").alias("component")), "exact")
    comp = groups.join(exact, "id", "left") \
        .select("set_key", "copies", F.coalesce("component", "id").alias("component"), "id")
    comp = comp.filter("copies > 1 or component <> id").select("set_key", "component")
    out = salted_join(base.select("doc_id", "n_shingles", "set_key"), comp, ["set_key"], F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    nodes, top = _nodes(docs)
    out = _components(nodes.select(F.col("_node").alias("doc_id"), F.col("text").cast("string").alias("text")), **parameters)
    real = lambda c: F.when(F.col(c) <= top, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component").alias("component_id"),
                      (F.col("component") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents of a component that are not its first, and without repeated rows of one node.

    Only documents that a bit map of fixed size marks as gone or repeated are shuffled, the others stay as they are."""
    nodes, _ = _nodes(docs)
    out = _components(nodes.select(F.col("_node").alias("doc_id"), F.col("text").cast("string").alias("text")), **parameters)
    touched = out.groupBy(F.col("doc_id").alias("_node")).agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("rows")) \
        .filter("component <> _node or rows > 1").select("_node", (F.col("component") == F.col("_node")).alias("_stays"))
    touched = stored(touched, "touched")
    place = F.pmod(F.xxhash64("_node"), F.lit(FILTER_BITS))
    marked = bitmaps.marked(nodes, bitmaps.bit_rows(touched.select(place.alias("p")), "p"), place, "_maybe")
    some = salted_join(marked.filter("_maybe"), touched, ["_node"], F.col("text")).filter(F.coalesce("_stays", F.lit(True))) \
        .dropDuplicates(["_node", "text"])
    return marked.filter("not _maybe").select(*docs.columns).union(some.select(*docs.columns))
