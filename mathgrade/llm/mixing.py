"""Mixing sources to target weights by weighted fair queueing.

Sources ordered by code point (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
a budget of 100 % of all words; no source is asked for more than
``MAX_EPOCHS`` times its words, and what it can't give goes to the others by
weight. Every source's documents are shuffled by a hash and queued, up to
``MAX_EPOCHS`` times; an entry's virtual finish time is the words its source
has queued up to it, divided by the source's target. The entries of all
sources, ordered by finish time, are taken until the budget is spent.

Nothing here sorts a source in one task. Shuffled positions come from hash
buckets of about ``BUCKET_ROWS`` rows: sums by bucket give offsets, and a
window inside each bucket the rest. The cut is found the same way: finish
times are spread evenly by construction, so buckets of equal width have equal
load; the bucket that crosses the budget is searched exactly, and the cut
(one row) is applied to all documents without another shuffle.

Definitions for odd input. A null text has size 0 and is never taken. Sources
without words have target 0. A null doc_id is hashed as ''. Rows with equal
ids are told apart by size; rows equal in both are interchangeable, and a cut
between them takes all or none. An empty table gives an empty mix. Extra
columns are ignored by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 20_000
MAX_BUCKETS = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Water filling in closed form: sources are filled in the order of cap / weight; one is capped if the budget
    left for it and all later ones, shared by weight, exceeds its cap. The windows hold one row per source."""
    pos = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                (F.row_number().over(pos) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("budget", F.sum("source_size").over(every))
    s = s.filter("source_size > 0")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("weight_left", F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    # capped sources come first; the others share what the first of them saw
    s = s.withColumn("share_left", F.first(F.when(~F.col("capped"), F.col("left")), True).over(every)) \
        .withColumn("share_weight", F.first(F.when(~F.col("capped"), F.col("weight_left")), True).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")) \
        .otherwise(F.col("weight") * F.col("share_left") / F.col("share_weight"))
    filled = s.select(F.col("source").alias("_source"), target.alias("target"))
    return sizes.join(filled, F.col("source").eqNullSafe(F.col("_source")), "left") \
        .select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def _shuffled() -> Column:
    """Shuffle order of a document inside its source (32 hex digits)."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return _mixed(rows, weights, bucket_rows)


def _mixed(rows: DataFrame, weights: tuple[int, ...], bucket_rows: int) -> DataFrame:
    rows = stored(rows.withColumn("turn", _shuffled()), "mix-rows")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    total = sizes.agg(F.sum("n"), F.sum("source_size")).first()
    n, budget = int(total[0] or 0), int(total[1] or 0)
    buckets = min(MAX_BUCKETS, max(1, n // bucket_rows))
    goal = targets(sizes.select("source", "source_size"), weights)

    # 1. words of the same source queued up to and including each document, in shuffled order
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"),
                          F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    goal = goal.withColumnsRenamed({"source": "_s"})
    offsets = offsets.join(goal, offsets["_s"].eqNullSafe(goal["_s"])).select(offsets["_s"], "_b", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.withColumn("_in", F.sum("size").over(inside))
    queued = queued.join(offsets, (F.col("bucket") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    queued = stored(queued.select("doc_id", "source", "size", "source_size", "target", "turn",
                                  (F.col("offset") + F.col("_in")).alias("queued")), "mix-queued")

    # 2. the entry at which the budget is spent, in the order of finish time, shuffle hash and size
    finish = lambda e: F.try_divide(F.col("queued") + F.lit(e) * F.col("source_size"), F.col("target"))
    epochs = F.array(*[finish(e) for e in range(MAX_EPOCHS)])
    entries = queued.filter("size > 0 and target > 0").select("turn", "size", F.explode(epochs).alias("finish"))
    # finish times are even up to 1; the cut lies near 1, so entries far beyond need no place of their own
    slot = F.least(F.floor(F.col("finish") * F.lit(buckets)), F.lit(2 * buckets)).cast("long")
    entries = entries.withColumn("slot", slot)
    load = entries.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = load.select("slot", "words", F.sum("words").over(Window.orderBy("slot")).alias("upto"))
    over = upto.filter(F.col("upto") > budget).orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("spent")).head()
    if over is None:
        cut = (float("inf"), "", 0)
    else:
        last = entries.filter(F.col("slot") == over["slot"])
        run = Window.partitionBy("slot").orderBy("finish", "turn", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        first_out = last.withColumn("run", F.sum("size").over(run)).filter(F.col("run") + F.lit(over["spent"]) > budget) \
            .orderBy("finish", "turn", "size").select("finish", "turn", "size").head()
        cut = tuple(first_out)
    copies = F.lit(0)
    for e in range(MAX_EPOCHS):
        f = finish(e)
        fits = (f < F.lit(cut[0])) | ((f == F.lit(cut[0])) & ((F.col("turn") < F.lit(cut[1]))
                                                              | ((F.col("turn") == F.lit(cut[1])) & (F.col("size") < F.lit(cut[2])))))
        copies = copies + F.when(fits & (F.col("target") > 0) & (F.col("size") > 0), 1).otherwise(0)
    return queued.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it was taken."""
    chosen = mix(docs, weights, bucket_rows).filter("copies > 0")
    chosen = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")) \
        .agg(F.max("copies").alias("_copies"))
    rows = docs.select(docs["doc_id"].alias("_doc"), docs["source"].cast("string").alias("_from"), word_count(docs["text"]).alias("_words"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    met = rows.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source"))
                    & (F.col("_words") == F.col("_size")))
    met = met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return met.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
