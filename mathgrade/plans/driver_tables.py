"""Views of the driver's tables in the model-evaluation data model.

The test tables are TPC-H-like; these functions derive, with plain column
expressions, the tables the evaluation operators consume, so that every
query's work grows with the input:

* ``samples``   - lineitem rows are sampled completions (question = order,
  sample number = line number); the completion text is rendered from the
  line's numbers in seven answer styles of two forms each; the reference answer and the
  difficulty level come from the order.
* ``token_logits`` - embeddings rows are next-token logit vectors.
* ``doc_features`` - documents with quality labels as a text/outcome table.
* ``chat_turns`` - conversations as chat messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def sample_value(qty: Column) -> Column:
    """The digit a sample's answer is made of (0..9)."""
    return F.floor(qty).cast("bigint") % 10


def reference_value(totalprice: Column) -> Column:
    """The digit a question's reference answer is made of (0..9)."""
    return F.floor(totalprice).cast("bigint") % 10


def shown(question_id: Column, digit: Column) -> Column:
    """The answer as written: plain, negative, with decimals, with a thousands
    comma or with a trailing zero, by question."""
    d, form = _s(digit), question_id % 6
    return (F.when(form == 1, F.concat(F.lit("-"), d)).when(form == 2, F.concat(d, F.lit(".5"))).when(form == 3, F.concat(F.lit("1,00"), d))
            .when(form == 4, F.concat(d, F.lit(".0"))).otherwise(d))


def number(question_id: Column, digit: Column) -> Column:
    """The number that ``shown`` writes."""
    d, form = digit.cast("double"), question_id % 6
    return F.when(form == 1, -d).when(form == 2, d + 0.5).when(form == 3, d + 1000).otherwise(d)


#: Text without numbers that makes some completions long.
FILLER = ("We look at every part of the problem in turn, write down what is given and what is asked, "
          "and then combine the parts with care until only one number is left to report. ")


def completion_text(question_id: Column, linenumber: Column, digit: Column, discount: Column) -> Column:
    """Render a completion: seven answer styles by line number, each in two
    forms (tags with blanks, two candidates, units and percent, annotated
    calculations, fractions, long reasoning, a change of approach)."""
    d = _s(F.round(discount * 100).cast("bigint"))
    v, two = shown(question_id, digit), question_id % 2 == 1
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when((linenumber == 1) & ~two, text("We add the parts. <answer>", v, "</answer>"))
        .when(linenumber == 1, text("First we add, next we check. <answer> ", v, " </answer> Not ", d, " then."))
        .when((linenumber == 2) & ~two, text("Step 1: ", d, " items.\n#### ", v))
        .when(linenumber == 2, text("Step 1: <<", d, "*2=", _s(F.round(discount * 200).cast("bigint")), ">> double. Step 2: stop.\n#### ", v, "\nChecked."))
        .when((linenumber == 3) & ~two, text("So the total is found. The final answer is: ", v))
        .when(linenumber == 3, text("Let's think step by step. ", FILLER, FILLER, "The final answer is ", v))
        .when((linenumber == 4) & ~two, text("Thus \\boxed{", v, "}"))
        .when(linenumber == 4, text("Thus \\boxed {", v, "} or \\(\\boxed{", d, "}\\)"))
        .when((linenumber == 5) & ~two, text("\\boxed{\\frac{", _s(digit * 2), "}{2}}"))
        .when(linenumber == 5, text("\\boxed{\\frac{", _s(digit), "}{4}}"))
        .when((linenumber == 6) & ~two, text("The answer is ", v, "."))
        .when(linenumber == 6, text("The answer is ", v, " apples, up ", d, "%."))
        .when((linenumber == 7) & two, text(FILLER, "Another approach: count instead. Answer: ", d, " dollars\nAnswer: ", v))
        .otherwise(text("I could not finish after ", d, " steps."))
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question: id, level 1..5, numeric reference answer and a
    worked reference solution ending in '#### n'."""
    o = table(spark, sf_dir, "orders")
    digit = reference_value(F.col("o_totalprice"))
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("level"),
        number(F.col("o_orderkey"), digit).alias("expected_answer"),
        F.concat(F.lit("Order status "), F.col("o_orderstatus"), F.lit(".\n#### "), shown(F.col("o_orderkey"), digit)).alias("answer"),
    )


def raw_samples(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Sampled completions; ``extra`` columns of the line travel along."""
    li = table(spark, sf_dir, "lineitem")
    v = sample_value(F.col("l_quantity"))
    return li.select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").alias("sample_number"),
        completion_text(F.col("l_orderkey"), F.col("l_linenumber"), v, F.col("l_discount")).alias("completion"),
        *extra,
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, level, expected_answer."""
    return questions(spark, sf_dir).select("question_id", "level", "expected_answer")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form sample table with texts: question_id, sample_number, level,
    expected_answer, completion."""
    return raw_samples(spark, sf_dir).join(references(spark, sf_dir), "question_id")


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings rows as (row id, logits as double array, target token id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"),
        F.col("label").alias("target"),
    )


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to their labels (inner: only labelled documents)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id")
