"""Extraction profiles: (text, expected) tables per profile, incl. reference quirks."""

import pytest
from pyspark.sql import functions as F

from mathgrade.functions import answers as A

BS = "\\"

CASES = {
    "six_way": [
        ("The answer is 42.", 42.0),
        ("<answer> -3.5 </answer> and later #### 7", -3.5),
        ("work\n#### 1,000", 1000.0),
        ("The final answer is: 12", 12.0),
        (f"so {BS}boxed{{25{BS}%}}", 25.0),
        (f"{BS}boxed{{{BS}frac{{11}}{{20}}}}", 0.55),
        ("no number here", None),
        ("first #### 3 then <answer>4</answer>", 3.0),
    ],
    "tag_or_hash": [("<ANSWER>5</ANSWER>", 5.0), ("#### -2", -2.0), ("answer is 9", None)],
    "ordered_list": [("The answer is 42", 42.0), ("#### 1,234.5", 1234.5), ("costs 7 dollars", 7.0), ("none", None)],
    "hybrid": [("Thus 4. Then 5 apples. Answer: 9 and Answer: 10", 10.0), (f"{BS}boxed{{-8}}", -8.0),
               ("It is 3 and 4", 4.0), ("nothing", None)],
    "hash_number": [("#### 1,200", 1200.0), ("#### 1.2.3", None), ("none", None)],
    "hash_phrase_boxed": [("The answer is 17", 17.0), (f"{BS}boxed {{5}}", 5.0), (f"{BS}boxed{{5}}", None)],
}


@pytest.mark.parametrize("profile", sorted(CASES))
def test_profiles(spark, profile):
    rows = CASES[profile]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", A.extract_answer(F.col("t"), profile).alias("v")).collect()}
    for i, (t, exp) in enumerate(rows):
        if exp is None:
            assert got[i] is None, (profile, t, got[i])
        else:
            assert got[i] == pytest.approx(exp), (profile, t, got[i])


def test_reference_compat_quirks(spark):
    df = spark.createDataFrame([("no answer",), (f"{BS}boxed{{{BS}frac{{11}}{{20}}}}",), ("#### 1,000",)], "t string")
    out = [r.v for r in df.select(A.six_way("t", fraction="numerator", missing_as_zero=True,
                                            strip_commas=False).alias("v")).collect()]
    assert out == [0.0, 11.0, 1.0]  # Q1, Q2, Q18


def test_boxed_int_and_lists(spark):
    df = spark.createDataFrame([(f"{BS}({BS}boxed{{12}}{BS})",), (f"[ x {BS}boxed{{7}} ]",), ("{{5}}",)], "t string")
    assert [r.v for r in df.select(A.boxed_int("t").alias("v")).collect()] == [12, 7, None]  # Q6: default NULL
    df2 = spark.createDataFrame([("a -1.5e3 b .5 c 7",)], "t string")
    assert df2.select(A.all_numbers("t").alias("v")).first().v == [-1500.0, 0.5, 7.0]


def test_last_line_and_markers(spark):
    df = spark.createDataFrame([("step one\nso total is 1,234 apples 5.",), ("nothing",)], "t string")
    assert [r.v for r in df.select(A.last_line_number("t").alias("v")).collect()] == ["5.0", ""]
    df = spark.createDataFrame([("x Answer: 3 Answer: 4 ",)], "t string")
    assert df.select(A.after_last_answer_marker("t").alias("v")).first().v == "4"
    df = spark.createDataFrame([("out: -3.5 then 2",)], "t string")
    assert df.select(A.program_number("t").alias("v")).first().v == -3.5
    assert df.select(A.program_number("t", signed=False).alias("v")).first().v == 3.5  # Q11


def test_float_text_is_pythons(spark):
    values = [0.0, 1.0, 12345678.0, 9999999.0, 1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.5e22, 0.001, 0.0005, 0.00012, 0.00001, 1.5e-7, 9007199254740993.0]
    df = spark.createDataFrame([(repr(v).replace("e+", "e"), v) for v in values], "t string, v double")
    assert [r.s for r in df.select(A.float_text(F.col("v")).alias("s")).collect()] == [repr(v) for v in values]
    line = spark.createDataFrame([("so 12345678",), ("it is 0.5",), ("total 1,000,000,000",)], "t string")
    assert [r.v for r in line.select(A.last_line_number("t").alias("v")).collect()] == ["12345678.0", "0.5", "1000000000.0"]
