"""Evaluation plans: extract -> grade -> per-question metrics -> breakdowns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, grading
from ..operators import metrics
from ..session import all_tasks


def grade_samples(samples: DataFrame, profile: str = "six_way", text: str = "completion",
                  expected: str = "expected_answer", rule: str = "relative") -> DataFrame:
    """Add ``pred`` (extracted number) and ``correct`` (graded) columns."""
    pred = answers.extract_answer(F.col(text), profile)
    out = samples.withColumn("pred", pred)
    if rule == "relative":
        ok = grading.relative("pred", expected)
    elif rule == "absolute":
        ok = grading.absolute("pred", expected)
    elif rule == "exact":
        ok = grading.exact("pred", expected)
    else:
        raise ValueError(f"unknown grading rule {rule!r}")
    return out.withColumn("correct", ok)


def extracted(samples: DataFrame, profile: str = "six_way", text: str = "completion") -> DataFrame:
    """Replace the text by its extracted number ``pred``: done before any join, so texts are never shuffled."""
    return samples.withColumn("pred", answers.extract_answer(F.col(text), profile)).drop(text)


def answer_counts(samples: DataFrame, profile: str = "six_way", text: str = "completion", key: str = "question_id") -> DataFrame:
    """One row per (question, extracted answer): ``cnt`` samples, the first sample's number. Aggregated map-side, so
    a question with a third of all samples shrinks to its distinct answers before the shuffle."""
    return extracted(samples, profile, text).groupBy(key, "pred") \
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("sample_number").alias("sample_number"))


#: Samples, at most, whose answer counts a task joins and groups.
TASK_ROWS = 500_000


def join_tasks(samples: DataFrame) -> int:
    """Tasks for the answer counts of ``samples``, by their number (a count that reads no column)."""
    return max(all_tasks(samples.sparkSession), math.ceil(samples.count() / TASK_ROWS))


def grade_counts(counts: DataFrame, questions: DataFrame, key: str = "question_id", expected: str = "expected_answer",
                 tasks: int | None = None) -> DataFrame:
    """Answer counts joined to their questions and graded. With ``tasks`` they are dealt over so many by their question:
    a task's sorts and hash tables hold far more than the bytes of a shuffle, by which its size is set otherwise."""
    if tasks:
        counts = counts.repartition(tasks, key)
    return counts.join(questions, key).withColumn("correct", grading.relative("pred", expected))


def pass_at_k_by_level(samples: DataFrame, questions: DataFrame, ks=(1, 5)) -> DataFrame:
    """Flagship: samples -> six-way extraction -> counts per answer -> relative
    grading -> unbiased pass@k per question -> mean per level."""
    graded = grade_counts(answer_counts(samples), questions)
    pq = metrics.pass_at_k(graded, ks=ks, keys=("question_id",), carry=("level",), weight="cnt")
    return pq.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.sum("n").alias("n_samples"),
        (F.sum("c") / F.sum("n")).alias("accuracy"),
        *[F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks],
    )
