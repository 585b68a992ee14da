"""Sources (multi-line CSV, literal lists) and the batch-inference surface
with stub model functions: retries, per-row errors, program checks."""

from pyspark.sql import functions as F

from mathgrade.operators import inference as INF
from mathgrade.plans import stubs
from mathgrade.sources import io as IO


def test_multiline_csv_and_headerless(spark, tmp_path):
    p = tmp_path / "qa.csv"
    p.write_text('Question,Answer_Text,Label\n"How many, in total?","Add them.\nThen ""double"".\n#### 12",Correct Solution\n'
                 '"Q2","<answer>3</answer>",Correct Solution\n')
    df = IO.read_qa_csv(spark, str(p), "Question STRING, Answer_Text STRING, Label STRING")
    rows = df.orderBy("Question").collect()
    assert rows[0].Answer_Text == 'Add them.\nThen "double".\n#### 12'
    assert len(rows) == 2
    h = tmp_path / "cand.csv"
    h.write_text("0,7,1,code,task,sol,0.5,,true,accepted\n")
    c = IO.read_headerless_csv(spark, str(h), "row_no INT, source_idx BIGINT, level INT, code STRING, task STRING, "
                               "solution STRING, novelty DOUBLE, difficulty DOUBLE, is_correct BOOLEAN, reason STRING")
    r = c.first()
    assert (r.source_idx, r.novelty, r.difficulty, r.is_correct) == (7, 0.5, None, True)


def test_literal_lists(spark):
    df = spark.createDataFrame([("[True, False, None]", "['a', 'b, c']"), ("[]", "not a list")], "b string, s string")
    out = df.select(IO.parse_list_literal("b").alias("b"), IO.parse_string_list("s").alias("s")).collect()
    assert out[0].b == [True, False, None] and out[0].s == ["a", "b, c"]
    assert out[1].b == [] and out[1].s is None


def test_generate_row_errors_and_retries(spark):
    df = spark.createDataFrame([(1, "ok one"), (2, "bad prompt"), (3, "ok three")], "id long, prompt string")
    out = INF.generate(df, "id", "prompt", 2, stubs.refusing_solver_factory).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.id, []).append(r)
    assert len(by_id[1]) == 2 and by_id[1][0].error is None
    assert len(by_id[2]) == 2
    assert by_id[2][0].completion is None and "model refused" in by_id[2][0].error and by_id[2][0].attempts == 3


def _counting(folder, replies):
    """A model that notes every prompt it is sent in a file of its own."""
    def factory():
        import os
        import uuid

        def fn(prompts, n):
            for p in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(p)
            return replies(prompts, n)
        return fn
    return factory


def _sent(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_missing_replies_and_null_prompts_are_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2**60 + 1), (2, None, None), (3, "b", 5)], "id long, prompt string, extra long")
    out = INF.generate(df, "id", "prompt", 3, _counting(str(tmp_path), lambda ps, n: [["x"] * (1 if p == "a" else n) for p in ps]), keep=["extra"]).collect()
    assert sorted((r.id, r.extra, r.sample_number, r.completion, r.error) for r in out if r.id != 2) == [
        (1, 2**60 + 1, 0, "x", None), (1, 2**60 + 1, 1, None, INF.MISSING_COMPLETION), (1, 2**60 + 1, 2, None, INF.MISSING_COMPLETION),
        (3, 5, 0, "x", None), (3, 5, 1, "x", None), (3, 5, 2, "x", None)]
    assert [(r.extra, r.error) for r in out if r.id == 2] == [(None, INF.MISSING_PROMPT)] * 3
    assert _sent(tmp_path) == ["a", "b"]


def test_failed_attempts_count_in_evaluate(spark):
    from mathgrade.plans import augment as AU

    def down():
        def fn(prompts, n):
            raise RuntimeError("down")
        return fn
    df = spark.createDataFrame([(1, "a", 4.0, "m")], "id long, prompt string, expected double, source string")
    r, = AU.evaluate(df, "id", "prompt", "expected", 3, down, metadata=["source"]).collect()
    assert (r.attempts, r.correct_count, r.passed, r.source) == (3, 0, False, "m")
    short, = AU.evaluate(df, "id", "prompt", "expected", 3, lambda: lambda ps, n: [["#### 4"] for _ in ps]).collect()
    assert (short.attempts, short.correct_count) == (3, 1)


GOOD = "<task>t</task><solution>#### 1</solution><code>```python\nprint(1)\n```</code>"


def test_repair_asks_once_a_round_and_keeps_text_on_failure(spark, tmp_path):
    df = spark.createDataFrame([(1, GOOD), (2, "bad"), (3, "worse")], "id long, text string")

    def replies(prompts, n):
        if any("worse" in p for p in prompts):
            raise RuntimeError("no")
        return [[GOOD] for _ in prompts]
    out = {r.id: r for r in INF.repair_format(df, "id", "text", lambda c: F.concat(F.lit("fix "), c), _counting(str(tmp_path), replies), rounds=3).collect()}
    assert [out[i].text for i in (1, 2, 3)] == [GOOD, GOOD, "worse"] and [out[i].format_ok for i in (1, 2, 3)] == [True, True, False]
    assert _sent(tmp_path).count("fix bad") <= 2 and _sent(tmp_path).count("fix worse") <= 2 * 3


def test_text_to_program_stops_when_it_agrees(spark, tmp_path):
    df = spark.createDataFrame([(1, "p1", "<answer>7</answer>"), (2, "p2", "<answer>8</answer>")], "id long, prompt string, sol string")
    rep = lambda ps, n: [[f"<code>```python\nprint({7})\n```</code>"] for _ in ps]
    out = {r.id: r for r in INF.text_to_program(df, "id", "prompt", "sol", _counting(str(tmp_path), rep), stubs.print_runner_factory, attempts=3).collect()}
    assert (out[1].is_correct, out[1].attempts, out[1].code) == (True, 1, "print(7)")
    assert (out[2].is_correct, out[2].attempts) == (False, 3)
    assert _sent(tmp_path) == ["p1"] + ["p2"] * 3


def test_augmentation_asks_each_prompt_once(spark, tmp_path):
    from mathgrade.plans import augment as AU
    calls = {k: tmp_path / k for k in ("augment", "solve")}
    for c in calls.values():
        c.mkdir()
    src = spark.createDataFrame([(1, "one " * 30), (2, "two")], "item_id long, text string")
    best, every = AU.augment_chain(spark, src, "item_id", "text", levels=2, samples=3, augmenter_factory=_counting(str(calls["augment"]), stubs.augmenter_factory()),
                                   runner_factory=stubs.print_runner_factory, solver_factory=_counting(str(calls["solve"]), stubs.solver_factory()), novelty_samples=2)
    assert every.count() == 2 * 2 * 3
    asked = _sent(calls["augment"])
    assert len(asked) == 4 and len(set(asked)) == 4 and any("one " * 30 in a for a in asked)
    solved = _sent(calls["solve"])
    assert len(solved) == len(set(solved)) == every.filter("is_correct").count()


def test_steps_continue_after_the_last(spark, tmp_path):
    from mathgrade.streaming import checkpointed as CK
    path = str(tmp_path / "steps")
    CK.write_in_steps(spark.range(10), "id", path, 4, "r")
    out = CK.write_in_steps(spark.range(14), "id", path, 4, "r")
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(14))
    assert {r.step for r in rows if r.id >= 10} == {3} and max(r.step for r in rows if r.id < 10) <= 2
    assert CK.write_in_steps(spark.range(14), "id", path, 4, "r").count() == 14


def test_check_program_signed(spark):
    df = spark.createDataFrame([(1, "```python\nprint(-4)\n```", "<answer>-4</answer>"),
                                (2, "print(5)", "#### 6"), (3, None, "#### 1")], "id long, code string, sol string")
    out = {r.id: r.is_correct for r in INF.check_program(df, "code", "sol", stubs.print_runner_factory).collect()}
    assert out == {1: True, 2: False, 3: False}
    u = {r.id: r.is_correct for r in INF.check_program(df, "code", "sol", stubs.print_runner_factory,
                                                        signed=False).collect()}
    assert u[1] is False  # Q11: the unsigned reference rule fails a correct negative answer
