"""Findings of round 3: work that has to spread over tasks, or to be done once."""
import math
import shutil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from mathgrade.functions import text as TX
from mathgrade.operators import aggregate as AG
from mathgrade.operators import inference as INF
from mathgrade.operators import metrics as M
from mathgrade.operators import stats as X
from mathgrade.plans import evaluate as ev
from mathgrade.plans import q_infer, q_stats, stubs
from mathgrade.streaming import checkpointed as CK


def _orders(spark, folder, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"),
                                        F.col("id").cast("double").alias("o_totalprice"), F.lit("O").alias("o_orderstatus"))
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_prompts_of_one_file_go_to_several_tasks(spark, tmp_path):
    out = q_infer.u02_retry(spark, _orders(spark, tmp_path, 200))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    assert sorted((r.question_id, r.attempts) for r in rows) == [(i, min(i % 4 + 1, 3)) for i in range(1, 201)]


def test_replies_of_short_calls_share_a_batch(spark):
    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in batches)], pa.int64())], ["n"])

    prompts = spark.range(0, 3000, 1, 1).select("id", F.lit("p").alias("prompt"))
    out = INF.generate(prompts, "id", "prompt", 2, stubs.solver_factory, batch_size=1, in_flight=4)
    assert out.mapInArrow(count, "n long").first().n <= 4
    got = [(r.id, r.sample_number) for r in out.collect()]
    assert got == [(i, j) for i in range(3000) for j in range(2)]


def test_many_steps_take_few_jobs(spark, tmp_path):
    path, ran = str(tmp_path / "steps"), []
    spark.sparkContext.setJobGroup("many-steps", "")
    out = CK.write_in_steps(spark.range(3000), "id", path, 10, "r")
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("many-steps")
    spark.sparkContext.setJobGroup("others", "")
    assert len(ran) < 300  # one per step or more before
    assert sorted(r.id for r in out.collect()) == list(range(3000))
    rows = {r.step: r.rows for r in CK.manifest(spark, path).collect()}
    assert rows == {r.step: r["count"] for r in out.groupBy("step").count().collect()} and max(rows) < 300
    again = CK.write_in_steps(spark.range(3200), "id", path, 10, "r")
    assert sorted(r.id for r in again.collect()) == list(range(3200))
    assert all((r.step >= 300) == (r.id >= 3000) for r in again.collect())


def test_a_wave_without_entry_is_replaced(spark, tmp_path):
    path = str(tmp_path / "steps")
    CK.write_in_steps(spark.range(1000), "id", path, 10, "r")
    entry = sorted((tmp_path / "steps/_log/run=r/manifest").iterdir())[0]
    shutil.move(entry, tmp_path / "lost")
    lost = CK.committed(spark, path).count()
    assert lost < 1000
    spark.range(5000, 5003).write.mode("append").parquet(f"{path}/run_id=r/step={entry.name.removeprefix('step=')}")
    assert sorted(r.id for r in CK.write_in_steps(spark.range(1000), "id", path, 10, "r").collect()) == list(range(1000))


def test_word_count_without_a_class_expression(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = ["", " ", "a", " a", "a ", "a  b\tc", "x", "x x ", "a​b \U0001F600　c", *[f"{c}p{c}{c}q{c}" for c in blanks], "".join(blanks), None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n for r in df.select("i", TX.word_count("t").alias("n")).collect()}
    assert got == {i: None if t is None else len(t.split()) for i, t in enumerate(texts)}
    plan = df.select(TX.word_count("t"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan.lower()


def _costly(seen):
    @F.udf("long")
    def cost(i):
        seen.add(1)
        return i % 7
    return cost


def test_costly_columns_of_bins_are_computed_once(spark):
    for bins in (X.bins_2d, X.hexagons):
        seen = spark.sparkContext.accumulator(0)
        df = spark.range(100).select(F.col("id").alias("x"), _costly(seen)("id").alias("y"))
        assert sum(r["count"] for r in bins(df, "x", "y", 5).collect()) == 100
        assert seen.value == 100  # twice and more before


def test_sampled_points_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(100).select("id", F.col("id").alias("x"), _costly(seen)("id").alias("y"))
    assert X.pair_scatter(df, "x", "y", 10, 42, "id").count() == 10
    assert seen.value == 100


def test_bootstrap_tasks_pass_on_sums_not_draws(spark):
    rows = [("ab"[i % 2], float(i), 1 + i % 20, 7919 * i + 1, 104729 * i + 3, 15485863 + i) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["_g", "_x", "_c", "_w0", "_w1", "_w2"])
    out = pa.Table.from_batches(X._replicate_sums(50)(iter([batch, batch])))
    assert out.num_rows == 2 * 50  # a row per value and replicate before
    edges, p, sums = X.poisson_edges(), X.DRAW_PRIME, {}
    for g, x, c, *w in rows * 2:
        for rep in range(50):
            u = [((w[0] % p * at + w[1]) % p * at + w[2]) % p for at in range(rep * 16 + 1, rep * 16 + 17)]
            if c <= 16:
                n = sum(v >= e for v in u[:c] for e in edges)
            else:
                a, b = ((v + 0.5) / p for v in u[:2])
                n = max(0, math.floor(c + math.sqrt(c) * (math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)) + 0.5))
            was = sums.get((g, rep), (0, 0))
            sums[g, rep] = (was[0] + n * x, was[1] + n)
    assert {(r["_g"], r["rep"]): (r["swx"], r["sw"]) for r in out.to_pylist()} == sums


def test_sweep_over_many_ranges_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, y = rng.integers(0, 60, 400), rng.integers(0, 2, 400)
    s = -rng.integers(1, 40, 400).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "n": n, "y": y}))
    alphas = [-1.0, 0.0, 2.0]  # powers without rounding differences, which break ties
    one = sorted(map(tuple, X.alpha_sweep(df, "s", "n", "y", alphas).collect()))
    monkeypatch.setattr(X, "SWEEP_ROWS", 40)
    many = sorted(map(tuple, X.alpha_sweep(df, "s", "n", "y", alphas).collect()))
    for (k, a, rows, rho), again in zip(one, many, strict=True):
        with np.errstate(divide="ignore"):
            d = np.power(n.astype(float), a)
        ok = d != 0
        score = pd.Series(s[ok] / d[ok])
        want = score.rank().corr(pd.Series(y[ok].astype(float)))
        assert (k, a, rows) == again[:3] == (alphas.index(a), a, ok.sum())
        assert abs(rho - want) < 1e-9 and abs(again[3] - want) < 1e-9


def test_sweep_needs_no_feature_that_it_does_not_use(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nfirst", "en", "s", 9), (2, "c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert q_stats.stored_metrics(spark, str(tmp_path), *q_stats.SWEPT).columns == ["logp_sum", "word_count", "quality"]


def test_accuracy_and_median_pass_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(100).select((F.col("id") % 4 == 0).alias("ok"), _costly(seen)("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 6), (True, None)], "ok boolean, v long"))
    r = AG.accuracy_and_median(df, "ok", "v").first()
    assert seen.value == 100  # several times before
    assert abs(r.accuracy - 26 / 101) < 1e-12 and r.median_v == 3.0
    empty = AG.accuracy_and_median(df.limit(0), "ok", "v").first()
    assert empty.accuracy is None and empty.median_v is None


def test_counts_are_joined_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(ev, "TASK_ROWS", 50)
    samples = spark.range(1000).select((F.col("id") % 300).alias("question_id"), F.col("id").alias("sample_number"),
                                       F.concat(F.lit("The answer is "), F.col("id") % 3, F.lit(".")).alias("completion"))
    questions = spark.range(300).select(F.col("id").alias("question_id"), F.lit(1.0).alias("expected_answer"))
    tasks = ev.join_tasks(samples)
    assert tasks == 20
    graded = ev.grade_counts(ev.answer_counts(samples), questions, tasks=tasks)
    out = M.correct_fraction_and_diversity(graded, "pred", weight="cnt").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) > 10 and len(out) == 300
