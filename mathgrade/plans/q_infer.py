"""Queries: batch inference surface (U) with deterministic stub models, and
sources/sinks (S) as write-then-read round trips of derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import inference as INF
from ..session import scratch_path
from ..sources import io as IO
from ..streaming import checkpointed as CK
from . import augment as AU
from . import driver_tables as dt
from . import q_text
from . import sql_views as S
from . import stubs
from .registry import register, rounded


def _prompts(spark, sf_dir):
    q = dt.questions(spark, sf_dir)
    return q.select("question_id", "level", "expected_answer",
                    F.concat(F.lit("Question "), F.col("question_id").cast("string"), F.lit(": how many items at level "),
                             F.col("level").cast("string"), F.lit("?")).alias("prompt"))


U11_SQL = f"""WITH {S.QUESTIONS},
p AS (SELECT question_id, expected_answer, 'Question ' || CAST(question_id AS VARCHAR) || ': how many items at level '
        || CAST(level AS VARCHAR) || '?' AS prompt FROM questions),
g AS (SELECT question_id, expected_answer, 'Let me think. The answer is ' || CAST((length(prompt) + j) % 10 AS VARCHAR) || '.' AS completion
      FROM p, range(3) t(j)),
x AS (SELECT question_id, {S.relative_sql(S.six_way_sql('completion'), 'expected_answer')} AS correct FROM g)
SELECT question_id, bool_or(correct) AS passed, max(CAST(correct AS DOUBLE)) AS pass_at_k,
  CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct_count, count(*) AS attempts,
  round(sum(CAST(correct AS INTEGER)) / count(*) * 100, 6) AS pass_percentage
FROM x GROUP BY question_id"""


@register("u11_evaluate_k_attempts", U11_SQL)
def u11_evaluate_k_attempts(spark, sf_dir):
    """k = 3 completions per question from a caller-supplied
    solver (deterministic stub), six-way extraction, grading, pass counts."""
    p = INF.dealt(_prompts(spark, sf_dir), "question_id")
    return rounded(AU.evaluate(p, "question_id", "prompt", "expected_answer", 3, stubs.solver_factory))


U05_SQL = f"""WITH {q_text.CANDIDATES_SQL},
b AS (SELECT item_id,
  CASE WHEN regexp_matches(reply, {S.q(A.P.CODE_BLOCK)}) THEN {S.strip_sql(f"regexp_extract(reply, {S.q(A.P.CODE_BLOCK)}, 1)")}
       ELSE {S.strip_sql(f"regexp_extract_all(reply, {S.q(A.P.PYTHON_FENCE)}, 1)[-1]")} END AS code,
  CASE WHEN regexp_matches(reply, {S.q(A.P.SOLUTION_BLOCK)}) THEN {S.strip_sql(f"regexp_extract(reply, {S.q(A.P.SOLUTION_BLOCK)}, 1)")} END AS solution
  FROM candidates)
SELECT item_id, TRY_CAST(nullif(regexp_extract(code, 'print\\((-?\\d+(?:\\.\\d+)?)\\)', 1), '') AS VARCHAR) AS program_output,
  coalesce(round(TRY_CAST(nullif(regexp_extract(code, 'print\\((-?\\d+(?:\\.\\d+)?)\\)', 1), '') AS DOUBLE), 3) =
    round(coalesce({S.dbl(S.grp("replace(solution, ',', '')", A.P.TAG_OR_HASH, 1))}, {S.dbl(S.grp("replace(solution, ',', '')", A.P.TAG_OR_HASH, 2))}), 3), false) AS is_correct
FROM b"""


@register("u05_check_program", U05_SQL)
def u05_check_program(spark, sf_dir):
    """Run each candidate's program with a caller-supplied runner (stub
    that evaluates print(<number>)), compare its first number with the
    solution's answer after rounding to 3 places."""
    c = q_text.candidates(spark, sf_dir)
    from ..functions import text as TX
    b = c.select("item_id", TX.extract_blocks("reply").alias("b")).select("item_id", "b.code", "b.solution")
    out = INF.check_program(b, "code", "solution", stubs.print_runner_factory)
    return out.select("item_id", "program_output", "is_correct")


U08_SQL = """WITH c AS (SELECT conv_id, text, CAST(length(text) % 97 AS DOUBLE) / 97.0 AS reward FROM conversations WHERE role = 'assistant')
SELECT conv_id, list({'reward': round(reward, 6), 'text': text} ORDER BY reward DESC, text DESC) AS candidates,
  arg_max({'reward': round(reward, 6), 'text': text}, (reward, text)) AS best
FROM c GROUP BY conv_id"""


@register("u08_rerank", U08_SQL)
def u08_rerank(spark, sf_dir):
    """Reward per candidate from a caller's reward model (stub),
    candidates ranked by reward and the best kept."""
    c = dt.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select("conv_id", "text")
    r = INF.rerank(c, ["conv_id"], "text", stubs.length_reward_factory)
    rnd = F.transform("candidates", lambda s: F.struct(F.round(s["reward"], 6).alias("reward"), s["text"].alias("text")))
    return r.select("conv_id", rnd.alias("candidates"),
                    F.struct(F.round(F.col("best.reward"), 6).alias("reward"), F.col("best.text").alias("text")).alias("best"))


_U09_LEVEL = """SELECT item_id, j, regexp_replace('Harder ' || j || ': ' || p, '^\\s+|\\s+$', '', 'g') AS task, length(p) % 50 + j + 1 AS ans
  FROM {source}, (VALUES (1), (2)) v(j)"""
_U09_BEST = """SELECT item_id, j, task, novelty FROM (
    SELECT *, 1 - len(list_filter([0, 1, 2, 3], lambda s: (length(task) + s) % 10 = ans)) / 4.0::DOUBLE AS novelty FROM {source})
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY novelty DESC, j) = 1"""
U09_SQL = f"""WITH p1 AS (SELECT item_id, text AS p FROM benchmark), c1 AS ({_U09_LEVEL.format(source="p1")}), b1 AS ({_U09_BEST.format(source="c1")}),
p2 AS (SELECT item_id, '<task>' || task || '</task>' AS p FROM b1),
c2 AS (SELECT item_id, j, regexp_replace(replace(task, '</task>', ''), '\\s+$', '') AS task, ans FROM ({_U09_LEVEL.format(source="p2")})),
b2 AS ({_U09_BEST.format(source="c2")})
SELECT item_id AS source_idx, level, CAST(j AS INTEGER) AS cand_no, novelty, 'accepted' AS reason
FROM (SELECT 1 AS level, * FROM b1 UNION ALL SELECT 2, * FROM b2)"""


@register("u09_augment_chain", U09_SQL)
def u09_augment_chain(spark, sf_dir):
    """Two levels of augmentation over every benchmark item with
    stub augmenter / runner / solver, as durable tables; best candidate per
    source and level."""
    b = dt.table(spark, sf_dir, "benchmark").select("item_id", "text")
    best, _all = AU.augment_chain(spark, b, "item_id", "text", levels=2, samples=4,
                                  augmenter_factory=stubs.augmenter_factory, runner_factory=stubs.print_runner_factory,
                                  solver_factory=stubs.solver_factory, novelty_samples=4,
                                  path=scratch_path(spark, "chain"))
    return best.select("source_idx", "level", "cand_no", "novelty", "reason")


S01_SQL = f"""WITH {S.QUESTIONS} SELECT question_id, level, expected_answer, answer FROM questions"""


@register("s01_csv_roundtrip", S01_SQL)
def s01_csv_roundtrip(spark, sf_dir):
    """Write the question table as CSV (multi-line quoted cells) to
    the shared scratch folder and read it back with an explicit schema."""
    path = scratch_path(spark, "questions-csv")
    IO.write_csv(dt.questions(spark, sf_dir), path)
    return IO.read_qa_csv(spark, path, "question_id BIGINT, level INT, expected_answer DOUBLE, answer STRING") \
        .select("question_id", "level", "expected_answer", "answer")


@register("s04_jsonl_gzip_roundtrip", q_text.D01_SQL)
def s04_jsonl_gzip_roundtrip(spark, sf_dir):
    """Chat examples written as gzip JSON Lines and read back."""
    path = scratch_path(spark, "chat-jsonl")
    IO.write_json(q_text.d01_chat_examples(spark, sf_dir), path, gzip=True)
    return IO.read_jsonl(spark, path, "item_id BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>")


S06_SQL = f"""WITH {S.GRADED}
SELECT question_id, list(correct ORDER BY sample_number, completion) AS correct_predictions
FROM graded GROUP BY question_id"""


@register("s06_parse_list_literal", S06_SQL)
def s06_parse_list_literal(spark, sf_dir):
    """Lists stored as Python-literal text ('[True, False]') parsed back natively."""
    from . import q_shape
    rows = q_shape._eval_rows(spark, sf_dir)
    txt = F.concat(F.lit("["), F.array_join(F.transform("correct_predictions",
                                                          lambda x: F.when(x, "True").otherwise("False")), ", "), F.lit("]"))
    return rows.select("question_id", IO.parse_list_literal(txt).alias("correct_predictions"))


S10_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id, CAST(('0x' || substr(md5(CAST(question_id AS VARCHAR)), 1, 8))::BIGINT % (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM questions) AS BIGINT) AS step,
  'r1' AS run_id FROM questions"""


@register("s10_write_in_steps", S10_SQL)
def s10_write_in_steps(spark, sf_dir):
    """Results committed in steps of about 1,000 rows, partitioned by
    (run_id, step); a second call resumes and adds nothing."""
    path = scratch_path(spark, "steps")
    q = dt.questions(spark, sf_dir).select("question_id")
    CK.write_in_steps(q, "question_id", path, 1000, "r1")
    out = CK.write_in_steps(q, "question_id", path, 1000, "r1")
    return out.select("question_id", F.col("step").cast("bigint"), F.col("run_id").cast("string"))


S10B_SQL = f"""WITH {S.QUESTIONS} SELECT question_id, 'The answer is ' || question_id AS completion, 's' AS run_id FROM questions"""


@register("s10b_stream_results", S10B_SQL)
def s10b_stream_results(spark, sf_dir):
    """Files that arrive in a folder, worked on in micro-batches with a commit log; the second call finds only
    the files that came after the first."""
    path = scratch_path(spark, "arriving")
    q = dt.questions(spark, sf_dir).select("question_id")
    odd = F.col("question_id") % 2 == 1
    def answer(batch):
        return batch.withColumn("completion", F.concat(F.lit("The answer is "), F.col("question_id").cast("string")))
    for part in (odd, ~odd):
        q.filter(part).repartition(3).write.mode("append").parquet(f"{path}/in")
        out = CK.stream_new_results(spark, f"{path}/in", q.schema, answer, f"{path}/out", "s", files_per_step=2)
    return out.select("question_id", "completion", "run_id")


U02_SQL = f"""WITH {S.QUESTIONS} SELECT question_id, CASE WHEN question_id % 4 < 3 THEN 'The answer is ' || question_id END AS completion,
  CASE WHEN question_id % 4 = 3 THEN 'ConnectionError: try 3' END AS error, CAST(least(question_id % 4 + 1, 3) AS INTEGER) AS attempts FROM questions"""


@register("u02_retry", U02_SQL)
def u02_retry(spark, sf_dir):
    """A client that fails up to three times per prompt, eight calls of a task in flight, three tries."""
    q = dt.questions(spark, sf_dir).select("question_id", F.concat(F.lit("Q "), F.col("question_id").cast("string")).alias("prompt"))
    out = INF.generate(INF.dealt(q, "question_id"), "question_id", "prompt", 1, stubs.flaky_factory, max_tries=3, batch_size=1, in_flight=8)
    return out.select("question_id", "completion", "error", "attempts")
