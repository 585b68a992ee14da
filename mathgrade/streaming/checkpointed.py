"""Durable, resumable result writing (S10/S11): micro-batches with a commit log.

``write_in_steps`` deals new rows into steps of about ``every_n`` rows and stores them as the run's input, in at most
``MOST_WAVES`` waves of consecutive steps. With ``work`` (model calls included), each step is worked on alone: its rows
are read back, ``work`` is applied, the result replaces the folder ``run_id=.../step=...``, and a manifest entry commits
it. Without, one job writes the folders of a wave and one entry commits its steps, so the number of jobs doesn't grow
with the table. A run that stops keeps the steps committed so far; the next call works on the others only. A step that stopped half-way is replayed into the same folder, so each row is in the
results once. Rows are dealt before they are worked on: ``work`` sees a row once, or again only in a replayed step.

``stream_new_results`` is the streaming form: a file source whose micro-batches are the steps. Spark's checkpoint fixes
the files of a batch before it runs, ``foreachBatch`` writes it under its batch id and commits it to the same manifest.

``committed`` reads the results of committed steps. The log lies below ``<path>/_log``, which Spark's readers skip.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.training import hash32
from ..session import all_tasks
from ..sources import io as IO

Work = Callable[[DataFrame], DataFrame]
#: Waves of steps that one call stores; up to so many steps, each is a wave of its own.
MOST_WAVES = 8
MANIFEST = "run_id string, step long, rows long, committed_at timestamp"


def _log(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/_log/run={run_id}"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed step of all runs."""
    pattern = f"{path.rstrip('/')}/_log/*/manifest/*"
    if not IO.exists(spark, f"{path.rstrip('/')}/_log/any-manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(pattern)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed steps, with ``run_id`` and ``step``."""
    steps = manifest(spark, path).select("run_id", "step")
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run_id=*")
    rows = rows.withColumn("run_id", F.col("run_id").cast("string")).withColumn("step", F.col("step").cast("long"))
    return rows.join(F.broadcast(steps), ["run_id", "step"], "left_semi")  # a row per step


def _entry(steps: DataFrame, path: str, run_id: str, first: int) -> None:
    """One manifest entry for ``steps`` (step, rows), under the number of the first of them."""
    spark = steps.sparkSession
    entry = steps.select(F.lit(run_id).alias("run_id"), F.col("step").cast("long").alias("step"),
                         F.col("rows").cast("long").alias("rows"), F.current_timestamp().alias("committed_at"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{_log(path, run_id)}/manifest/step={first}")
    spark.range(1).coalesce(1).write.mode("ignore").parquet(f"{path.rstrip('/')}/_log/any-manifest")


def _commit(rows: DataFrame, path: str, run_id: str, step: int) -> None:
    """Write a step under its own name, then its manifest entry."""
    spark = rows.sparkSession
    folder = f"{path.rstrip('/')}/run_id={run_id}/step={step}"
    rows.write.mode("overwrite").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    _entry(spark.range(1).select(F.lit(step).alias("step"), F.lit(n).alias("rows")), path, run_id, step)


def _commit_wave(rows: DataFrame, path: str, run_id: str, steps: list[int]) -> None:
    """Write the folders of several steps (column ``step``) in one job, then one manifest entry for all."""
    spark, run = rows.sparkSession, f"{path.rstrip('/')}/run_id={run_id}"
    rows.repartition(min(all_tasks(spark), len(steps)), "step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("step").parquet(run)
    written = spark.read.schema(rows.schema).option("basePath", run).parquet(*[f"{run}/step={s}" for s in steps])
    _entry(written.groupBy("step").agg(F.count(F.lit(1)).alias("rows")), path, run_id, steps[0])


def _steps(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return manifest(spark, path).filter(F.col("run_id") == run_id).select("step")


def write_in_steps(df: DataFrame, key: str, path: str, every_n: int, run_id: str, work: Work | None = None) -> DataFrame:
    """Work on the rows of ``df`` whose key is in no step yet, step by step; returns ``committed(path)``.

    ``df`` is evaluated once, to store the input; put costly work into ``work``. New rows are dealt by a hash of the
    key into steps after the run's last one, so no sort and no global numbering is needed."""
    spark, log = df.sparkSession, _log(path, run_id)
    staged, last = f"{log}/input", -1
    todo = df
    if IO.exists(spark, staged):
        before = spark.read.parquet(staged)
        todo = IO.resume(todo, before, key)
        last = before.agg(F.coalesce(F.max("step").cast("long"), F.lit(-1))).first()[0]
    if not manifest(spark, path).filter(F.col("run_id") != run_id).isEmpty():
        others = committed(spark, path).filter(F.col("run_id") != run_id)
        todo = IO.resume(todo, others, key)
    raw = f"{log}/raw-{uuid4().hex}"
    todo.write.parquet(raw)
    new = spark.read.schema(todo.schema).parquet(raw)
    steps = math.ceil(new.count() / every_n)  # of the stored rows: the input isn't evaluated again
    if steps:
        step, per_wave = F.pmod(hash32(F.col(key)), F.lit(steps)), math.ceil(steps / MOST_WAVES)
        wave = F.floor(F.col("step") / per_wave) * per_wave + F.lit(last + 1)  # the number of its first step
        dealt = new.withColumn("step", step.cast("long")).withColumn("_wave", wave.cast("long"))
        dealt = dealt.withColumn("step", F.col("step") + F.lit(last + 1))
        dealt.repartition("_wave").write.mode("append").partitionBy("_wave").parquet(staged)
    if IO.exists(spark, staged):
        run_pending(spark, path, run_id, df.schema, work)
    else:  # no row at all so far: an empty step keeps the columns
        _commit(work(new) if work else new, path, run_id, -1)
    return committed(spark, path)


def run_pending(spark: SparkSession, path: str, run_id: str, schema, work: Work | None = None) -> None:
    """Work on the stored steps of a run that are not committed, in order."""
    staged = f"{_log(path, run_id)}/input"
    known = spark.read.parquet(staged).select(F.col("_wave").cast("long").alias("wave"), "step").distinct()
    pending = known.join(_steps(spark, path, run_id), "step", "left_anti")
    pending = pending.groupBy("wave").agg(F.sort_array(F.collect_list("step")).alias("steps")).orderBy("wave")
    for row in pending.collect():  # step numbers only
        rows = spark.read.schema(T.StructType([*schema, T.StructField("step", T.LongType())])).parquet(f"{staged}/_wave={row['wave']}")
        if work is None and len(row["steps"]) > 1:
            _commit_wave(rows.filter(F.col("step").isin(row["steps"])), path, run_id, row["steps"])
            continue
        for step in row["steps"]:
            one = rows.filter(F.col("step") == step).drop("step")
            _commit(work(one) if work else one, path, run_id, step)


def stream_new_results(spark: SparkSession, src_dir: str, schema, work: Work, path: str, run_id: str,
                       files_per_step: int = 100) -> DataFrame:
    """Work on the files of ``src_dir`` that no step has yet, ``files_per_step`` a step; returns ``committed(path)``."""
    done = {r["step"] for r in _steps(spark, path, run_id).collect()}

    def step(batch: DataFrame, number: int) -> None:
        if number not in done:  # a replayed batch that was committed before Spark noted it
            _commit(work(batch), path, run_id, number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(src_dir)
    source.writeStream.foreachBatch(step).option("checkpointLocation", f"{_log(path, run_id)}/checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    return committed(spark, path)
