"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage
    and is shared by several readers. Survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_of: Column, salts: int = 8,
                how: str = "left", many: str | None = None) -> DataFrame:
    """Equi-join of ``left`` with ``right`` (unique on ``keys``) in which a key
    that holds a large share of ``left`` is spread over ``salts`` tasks, to each of which the row of ``right`` goes.
    With ``many``, a boolean of both sides that follows from the keys, only the keys that have it."""
    salt, every = F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"), F.array(*[F.lit(i) for i in range(salts)])
    if many is not None:
        salt, every = F.when(F.col(many), salt).otherwise(F.lit(0)), F.when(F.col(many), every).otherwise(F.array(F.lit(0)))
    a = left.withColumn("_salt", salt)
    b = right.withColumn("_salt", F.explode(every))
    if many is not None:
        a, b = a.drop(many), b.drop(many)
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def lowest(df: DataFrame, group: str, order: list[str], n: int, spread: Column, salts: int = 16) -> DataFrame:
    """The ``n`` first rows of each group in ``order``, with their place ``pos``.

    Spark drops all but ``n`` rows per group and task before the shuffle; here ``salts`` tasks per group cut the rest
    down first, so that the last task of a group gets at most ``n * salts`` rows, however large the group is."""
    first = Window.partitionBy(group, "_salt").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    few = df.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit("lowest")), F.lit(salts))) \
        .withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= n).drop("_salt")
    return few.withColumn("pos", F.row_number().over(last)).filter(F.col("pos") <= n)


def fraction_bucket(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus`` (a null counts as '')."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in a stream of batches sorted by it. Each run must
    be bounded by the caller; only one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        a = 0
        for b in cuts.tolist():
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held, a = [], b
        held.append(batch.slice(a))
    if held:
        yield pa.Table.from_batches(held)


def binary_matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A column of equally long binaries as a matrix with one row each."""
    raw = b"".join(column.to_pylist())
    out = np.frombuffer(raw, dtype)
    return out.reshape(len(column), -1)


def to_binary(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, one row each."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(mapper: Mapper) -> Mapper:
    """The mapper, giving freed memory back to the system when a task ends: Python workers live on and serve the
    tasks of later stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc has it
                trim(0)
    return run


def wide_rows(group_bytes: int) -> dict[str, int]:
    """Options of ``stored`` for rows of megabytes. Parquet's writer else looks at the size of pages and row groups every 100
    rows only: a column of a whole file is a page, for which the compressors of writer and readers hold buffers outside the
    heap, and a row group, which a reader holds at once."""
    return {"parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.block.size": group_bytes}


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int, size: int | None = None, split: int | None = None) -> Iterator[None]:
    """For jobs run inside: at most ``rows`` rows (and about ``size`` bytes) of an Arrow batch, where a row is large. The
    JVM and the Python worker each hold a whole batch, beside the heap. Files are read ``split`` bytes a task."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size,
           "spark.sql.files.maxPartitionBytes": split}
    new = {key: str(value) for key, value in new.items() if value is not None}
    before = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def row_and_text(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``; ``texts`` reads the text inside it, so it isn't sent twice."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def texts(batch: pa.RecordBatch) -> pa.Array:
    """The text of a batch of ``row_and_text``, as strings."""
    return batch.column("row").field("text").cast(pa.string())
