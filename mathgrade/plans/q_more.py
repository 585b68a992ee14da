"""Queries for the remaining sources, text variants, joins and model-boundary
operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import aggregate as AG
from ..operators import inference as INF
from ..operators import metrics as M
from ..operators import shape as SH
from ..operators import stats as X
from ..operators.training import hash32
from ..session import scratch_path
from ..sources import io as IO
from . import augment as AU
from . import driver_tables as dt
from . import q_shape, q_stats, q_text, stubs
from . import sql_views as S
from .registry import register, rounded

# --------------------------------------------------------------------------
# S
# --------------------------------------------------------------------------

S01B_SQL = f"WITH {S.QUESTIONS} SELECT question_id, level, answer FROM questions"


@register("s01b_pipe_separated", S01B_SQL)
def s01b_pipe_separated(spark, sf_dir):
    """Multi-line cells in a '|'-separated file."""
    path = scratch_path(spark, "questions-pipe")
    IO.write_csv(dt.questions(spark, sf_dir).select("question_id", "level", "answer"), path, sep="|")
    return IO.read_qa_csv(spark, path, "question_id BIGINT, level INT, answer STRING", sep="|")


S02_SQL = "SELECT o_orderkey AS row_no, o_custkey AS source_idx, o_totalprice AS novelty, o_orderpriority AS reason FROM orders"


@register("s02_headerless_csv", S02_SQL)
def s02_headerless_csv(spark, sf_dir):
    """A file without header, columns named and typed by position."""
    path = scratch_path(spark, "headerless")
    dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority") \
        .write.option("header", False).option("escape", '"').csv(path)
    return IO.read_headerless_csv(spark, path, "row_no BIGINT, source_idx BIGINT, novelty DOUBLE, reason STRING")


S03_SQL = "SELECT c_custkey AS id, c_nationkey AS nation, round(c_acctbal, 6) AS balance FROM customer"


@register("s03_json_array", S03_SQL)
def s03_json_array(spark, sf_dir):
    """S3: files that each hold one JSON array of nested records (about 500 a file)."""
    c = dt.table(spark, sf_dir, "customer")
    files = c.count() // 500 + 1
    rec = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).alias("data"))
    arrays = c.withColumn("file", F.pmod(hash32("c_custkey"), F.lit(files))).groupBy("file").agg(F.to_json(F.collect_list(rec)).alias("value"))
    path = scratch_path(spark, "json-arrays")
    arrays.write.partitionBy("file").text(path)
    out = IO.read_records_json(spark, path, "id BIGINT, data STRUCT<nation: BIGINT, balance: DOUBLE>")
    return rounded(out.select("id", "data.*"))


S05_SQL = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS dataset FROM orders"


@register("s05_load_many", S05_SQL)
def s05_load_many(spark, sf_dir):
    """Several files in one tagged table; a missing one is reported and skipped."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    base = scratch_path(spark, "many")
    o.filter("o_orderstatus = 'F'").select("o_orderkey").write.parquet(f"{base}/done")
    o.filter("o_orderstatus <> 'F'").select("o_orderkey").write.parquet(f"{base}/open")
    paths = {"done": f"{base}/done", "gone": f"{base}/gone", "open": f"{base}/open"}
    return IO.load_many(spark, paths, lambda sp, p: sp.read.parquet(p))


S06B_SQL = "SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS words FROM conversations"


@register("s06b_string_lists", S06B_SQL)
def s06b_string_lists(spark, sf_dir):
    """Lists of strings in Python-literal form."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    text = F.when(F.size(words) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")))
    c = dt.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"))
    return c.select("conv_id", "turn", IO.parse_string_list("t").alias("words"))


S07_SQL = """SELECT position, item_id, text FROM (SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS position, * FROM benchmark)
WHERE position % 3 = 0"""


@register("s07_problem_set_rows", S07_SQL)
def s07_problem_set_rows(spark, sf_dir):
    """A named problem set and its rows by position (every third)."""
    sets = IO.ProblemCatalog(spark, {"benchmark": f"{sf_dir.rstrip('/')}/benchmark.parquet"})
    return SH.rows_at(sets.load("benchmark"), ["item_id"], F.col("position") % 3 == 0) \
        .select(F.col("position").cast("bigint"), "item_id", "text")


# --------------------------------------------------------------------------
# T
# --------------------------------------------------------------------------

T03_SQL = f"""WITH {q_text.CANDIDATES_SQL},
g AS (SELECT item_id, reply, regexp_extract(reply, {S.q(P.GREEDY_CODE)}, 1) AS inner_code, regexp_extract(reply, {S.q(P.GREEDY_SOLUTION)}, 1) AS solution,
        TRY_CAST(CASE WHEN regexp_full_match(trim(regexp_extract(regexp_extract(reply, {S.q(P.GREEDY_SOLUTION)}, 1), '#### (.*)', 1)), '[+-]?\\d+')
          THEN trim(regexp_extract(regexp_extract(reply, {S.q(P.GREEDY_SOLUTION)}, 1), '#### (.*)', 1)) END AS BIGINT) AS final_answer FROM candidates)
SELECT item_id, regexp_extract(reply, {S.q(P.GREEDY_TASK)}, 1) AS task, solution,
  coalesce({S.strip_sql(f"regexp_extract_all(inner_code, {S.q(P.GREEDY_FENCE)}, 1)[-1]")}, '') AS code, final_answer,
  CASE WHEN NOT regexp_matches(reply, {S.q(P.GREEDY_CODE)}) THEN 'no_code' WHEN NOT regexp_matches(reply, {S.q(P.GREEDY_TASK)}) THEN 'no_task'
       WHEN NOT regexp_matches(reply, {S.q(P.GREEDY_SOLUTION)}) THEN 'no_solution' WHEN final_answer IS NULL THEN 'no_final_answer' END AS reason
FROM g"""


@register("t03_extract_blocks_greedy", T03_SQL)
def t03_extract_blocks_greedy(spark, sf_dir):
    """Greedy blocks, the final answer and the first thing missing."""
    c = q_text.candidates(spark, sf_dir)
    return c.select("item_id", TX.extract_blocks_greedy("reply").alias("b")).select("item_id", "b.*")


T04_SQL = f"""WITH {q_text.CANDIDATES_SQL}
SELECT item_id, CASE WHEN item_id % 5 > 0 THEN 'think ' || CAST(item_id AS VARCHAR) END AS scratchpad, item_id % 5 > 0 AS json_ok,
  CASE WHEN item_id % 5 > 0 AND regexp_matches(reply, {S.q(P.TASK_BLOCK)}) THEN {S.strip_sql(f"regexp_extract(reply, {S.q(P.TASK_BLOCK)}, 1)")} END AS task
FROM candidates"""


@register("t04_json_reply", T04_SQL)
def t04_json_reply(spark, sf_dir):
    """T4: JSON replies with a scratchpad and a public block; every fifth one is broken."""
    c = q_text.candidates(spark, sf_dir)
    js = F.to_json(F.struct(F.concat(F.lit("think "), F.col("item_id").cast("string")).alias("scratchpad"), F.col("reply").alias("public")))
    c = c.withColumn("js", F.when(F.col("item_id") % 5 > 0, js).otherwise(F.substring(js, F.lit(1), F.length(js) - 2)))
    r = c.select("item_id", TX.extract_json_reply("js").alias("r"))
    return r.select("item_id", "r.scratchpad", "r.json_ok", F.col("r.blocks.task").alias("task"))


T06_SQL = f"""WITH {q_text.CANDIDATES_SQL}
SELECT item_id, CASE WHEN NOT contains(reply, '<code>') AND regexp_matches(reply, '(?s)```python.*?```')
  THEN '<code>' || chr(10) || regexp_extract(reply, '(?s)(```python.*?```)', 1) || chr(10) || '</code>' || chr(10) || reply ELSE reply END AS reply FROM candidates"""


@register("t06_repair_code_tag", T06_SQL)
def t06_repair_code_tag(spark, sf_dir):
    """A bare fence gets its code tag."""
    return q_text.candidates(spark, sf_dir).select("item_id", TX.repair_code_tag("reply").alias("reply"))


T11_SQL = f"""SELECT b.item_id, replace(replace(replace({S.q(P.JUDGE_TEMPLATE)}, '{{question}}', b.text), '{{answer_a}}', 'It is ' || CAST(b.item_id AS VARCHAR)),
  '{{answer_b}}', 'It is ' || CAST(b.item_id * 2 AS VARCHAR)) AS prompt FROM benchmark b"""


@register("t11_judge_prompt", T11_SQL)
def t11_judge_prompt(spark, sf_dir):
    """The pairwise judge's prompt for two answers."""
    it = lambda k: F.concat(F.lit("It is "), (F.col("item_id") * k).cast("string"))
    b = dt.table(spark, sf_dir, "benchmark").withColumn("a", it(1)).withColumn("b", it(2))
    return b.select("item_id", TX.judge_prompt("text", "a", "b").alias("prompt"))


T05_SQL = f"""WITH {q_text.CANDIDATES_SQL},
p AS (SELECT item_id, i, string_split(reply, '</solution>')[i] AS piece, len(string_split(reply, '</solution>')) AS n
      FROM (SELECT item_id, reply, unnest(range(1, len(string_split(reply, '</solution>')) + 1)) AS i FROM candidates)),
f AS (SELECT item_id, i, n, piece, instr(piece, '<solution>') AS st FROM p),
b AS (SELECT *, CASE WHEN st > 0 THEN substr(piece, st) END AS block FROM f),
c AS (SELECT *, instr(block, '<answer>') AS op FROM b),
d AS (SELECT *, CASE WHEN op > 0 AND instr(substr(block, op), '</answer>') > 0 THEN op + instr(substr(block, op), '</answer>') + 7 END AS en FROM c)
SELECT item_id, string_agg(CASE WHEN i < n AND en IS NOT NULL
    THEN substr(piece, 1, st - 1) || substr(block, 1, en) || regexp_replace(substr(block, en + 1), '(?s)<answer>.*?</answer>', '', 'g') ELSE piece END,
  '</solution>' ORDER BY i) AS reply FROM d GROUP BY item_id"""


@register("t05_dedup_answer_tags", T05_SQL)
def t05_dedup_answer_tags(spark, sf_dir):
    """T5: keep only the first answer tag inside each solution block."""
    return q_text.candidates(spark, sf_dir).select("item_id", TX.dedup_answer_tags("reply").alias("reply"))


D03B_SQL = f"""WITH c AS ({q_text.CHATML_SQL})
SELECT conv_id, {q_text._ids_sql('chat_text')} AS input_ids FROM c"""


@register("d03b_tokenise_whole", D03B_SQL)
def d03b_tokenise_whole(spark, sf_dir):
    """D3 without a fixed width: no row is truncated or padded."""
    from ..operators import training as D
    c = q_text._chat_text(spark, sf_dir)
    enc = D.pad_truncate(D.piece_ids(D.whitespace_pieces("chat_text")), None)
    return c.select("conv_id", enc["input_ids"].alias("input_ids"))


# --------------------------------------------------------------------------
# P, J, G, X
# --------------------------------------------------------------------------

P04_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id, CAST(row_number() OVER (ORDER BY question_id) - 1 AS BIGINT) AS source_idx FROM questions"""


@register("p04_row_number_default", P04_SQL)
def p04_row_number_default(spark, sf_dir):
    """A missing source id becomes the row number."""
    q = dt.questions(spark, sf_dir).select("question_id")
    return SH.default_column(q, "source_idx", order=["question_id"]).select("question_id", F.col("source_idx").cast("bigint"))


P10_SQL = f"""{q_shape.GRADED_Q}
SELECT question_id, sample_number, round(pred, 6) AS pred FROM graded WHERE pred IS NOT NULL"""


@register("p10_drop_missing", P10_SQL)
def p10_drop_missing(spark, sf_dir):
    """P10: samples without an extracted answer go."""
    g = q_shape._graded(spark, sf_dir).select("question_id", "sample_number", "pred")
    return rounded(SH.drop_missing(g, "pred"))


P22B_SQL = f"""{q_shape._pq_sql()},
d AS (SELECT o_orderkey AS question_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS level FROM orders),
a AS (SELECT d.level, avg(CAST(passed AS DOUBLE)) AS pass_rate FROM d JOIN pq USING (question_id) GROUP BY d.level),
c AS (SELECT level, avg(CAST(passed AS DOUBLE)) AS curve FROM pq GROUP BY level)
SELECT a.level, round(pass_rate, 6) AS pass_rate, round(curve, 6) AS curve FROM a LEFT JOIN c USING (level)"""


@register("p22b_level_curves", P22B_SQL)
def p22b_level_curves(spark, sf_dir):
    """Datasets as levels joined to the curve of the leveled questions."""
    pq = q_shape._pq(spark, sf_dir)
    d = q_shape.p22_datasets_as_levels(spark, sf_dir).withColumnRenamed("o_orderkey", "question_id")
    rate = F.avg(F.col("passed").cast("double"))
    own = d.join(pq.drop("level"), "question_id").groupBy("level").agg(rate.alias("pass_rate"))
    return rounded(SH.level_curves(own, pq.groupBy("level").agg(rate.alias("curve"))))


J11_SQL = f"""WITH {S.QUESTIONS}
SELECT CAST(row_number() OVER (ORDER BY question_id) - 1 AS BIGINT) AS original_id, question_id, answer,
  nullif(replace(regexp_extract(answer, '####\\s*([0-9\\.,\\-]+)', 1), ',', ''), '') AS solution FROM questions ORDER BY 1"""


@register("j11_full_test_set", J11_SQL)
def j11_full_test_set(spark, sf_dir):
    """The full test set with positions and extracted solutions, in order."""
    q = dt.questions(spark, sf_dir).select("question_id", "answer")
    return SH.full_test_set(q, "question_id", "answer").select(F.col("original_id").cast("bigint"), "question_id", "answer", "solution")


J12_SQL = f"""{q_shape._pq_sql()}
SELECT pq.question_id, attempts, correct_count, o_custkey AS source_idx, pq.level, o_orderstatus AS code, o_totalprice AS novelty, CAST(length(o_orderpriority) AS DOUBLE) AS difficulty
FROM pq JOIN orders ON o_orderkey = question_id"""


@register("j12_attach_metadata", J12_SQL)
def j12_attach_metadata(spark, sf_dir):
    """Source, level, code, novelty and difficulty on evaluation rows."""
    o = dt.table(spark, sf_dir, "orders")
    cand = o.select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("source_idx"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"),
                    F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("novelty"), F.length("o_orderpriority").cast("double").alias("difficulty"))
    return SH.attach_metadata(q_shape._pq(spark, sf_dir).drop("passed"), cand, "question_id", ["source_idx", "level", "code", "novelty", "difficulty"])


@register("g20_order_by_abs", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY abs(c_acctbal) DESC")
def g20_order_by_abs(spark, sf_dir):
    """By absolute value, largest first."""
    return AG.order_by_abs(dt.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


X05_SQL = f"""WITH {q_stats.DOC_SQL},
n AS (SELECT *, CASE WHEN step_count > 5 THEN step_count END AS some_steps FROM dm)
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, count(*) AS n, round({q_stats._pearson_sql(m, 'quality')}, 6) AS pearson FROM n HAVING count(*) = count({m})"
    for m in ("n_chars", "some_steps", "word_count"))


@register("x05_skip_metrics_with_nulls", X05_SQL)
def x05_skip_metrics_with_nulls(spark, sf_dir):
    """Metrics that hold a NULL are left out."""
    d = q_stats.doc_metrics(spark, sf_dir).withColumn("some_steps", F.when(F.col("step_count") > 5, F.col("step_count")))
    out = X.correlation_table(d, ["n_chars", "some_steps", "word_count"], "quality", skip_with_nulls=True)
    return rounded(out.select("metric", "n", "pearson"))


X22_SQL = f"""WITH {q_stats.ALL_SQL}
SELECT doc_id, n_chars, word_count FROM am ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 300"""


@register("x22_pair_scatter", X22_SQL)
def x22_pair_scatter(spark, sf_dir):
    """A seeded sample of 300 points for a scatter plot."""
    return X.pair_scatter(q_stats.all_metrics(spark, sf_dir), "n_chars", "word_count", 300, 42, "doc_id")


# --------------------------------------------------------------------------
# U
# --------------------------------------------------------------------------

_LOGP = "list_transform(string_split(text, ' '), lambda w: -((length(w) % 5) + 1) / 4)"
U03_SQL = f"SELECT item_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens, round(exp(-list_avg({_LOGP})), 6) AS perplexity FROM benchmark"


@register("u03_score_tokens", U03_SQL)
def u03_score_tokens(spark, sf_dir):
    """Token log-probs from a caller's scorer (stub), perplexity natively."""
    b = dt.table(spark, sf_dir, "benchmark").withColumn("prompt", F.lit("Read:"))
    s = INF.score_tokens(b, "item_id", "prompt", "text", stubs.scorer_factory)
    return rounded(s.select("item_id", F.size("tokens").alias("n_tokens"), M.perplexity("log_p").alias("perplexity")))


U04_SQL = f"""WITH {q_text.CANDIDATES_SQL}
SELECT item_id, CASE WHEN regexp_matches(reply, {S.q(P.SOLUTION_BLOCK)}) THEN reply ELSE reply || '<solution>#### 1</solution>' END AS reply, true AS format_ok FROM candidates"""


@register("u04_repair_format", U04_SQL)
def u04_repair_format(spark, sf_dir):
    """U4: replies without a block are sent back (stub) until they parse."""
    c = q_text.candidates(spark, sf_dir)
    return INF.repair_format(c, "item_id", "reply", lambda t: F.concat(F.lit("Repair: "), t), stubs.repair_factory)


U05B_SQL = f"""WITH {q_text.CANDIDATES_SQL}
SELECT item_id, conv_id % 97 AS output, coalesce(round((conv_id % 97)::DOUBLE, 3) = round({S.dbl(S.grp("reply", P.TAG_OR_HASH, 2))}, 3)
  AND regexp_matches(reply, '<solution>'), false) AS is_correct
FROM candidates JOIN (SELECT DISTINCT conv_id FROM conversations) ON conv_id = item_id"""


@register("u05b_captured_outputs", U05B_SQL)
def u05b_captured_outputs(spark, sf_dir):
    """U5 on a table of captured outputs: graded without running anything."""
    c = q_text.candidates(spark, sf_dir).select("item_id", TX.extract_blocks("reply")["solution"].alias("solution"))
    outs = dt.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id")).distinct().withColumn("output", F.col("item_id") % 97)
    j = c.join(outs, "item_id").withColumn("text", F.concat(F.lit("out: "), F.col("output").cast("string")))
    return INF.grade_output(j, "text", "solution").select("item_id", "output", "is_correct")


U06_SQL = """SELECT item_id, 'print(' || CAST(item_id + item_id % 2 AS VARCHAR) || ')' AS code, CAST(item_id + item_id % 2 AS VARCHAR) AS program_output,
  item_id % 2 = 0 AS is_correct, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 3 END AS attempts FROM benchmark"""


@register("u06_text_to_program", U06_SQL)
def u06_text_to_program(spark, sf_dir):
    """A program per item (stub), asked again until its output is right, three times at most."""
    n = F.col("item_id").cast("string")
    b = dt.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Program for "), n).alias("prompt"), F.concat(F.lit("#### "), n).alias("solution"))
    out = INF.text_to_program(b, "item_id", "prompt", "solution", stubs.program_factory, stubs.print_runner_factory)
    return out.select("item_id", "code", "program_output", "is_correct", "attempts")


U07_SQL = """SELECT item_id, length(text) % 3 <> 0 AS verified, CASE WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS verdict,
  CASE WHEN length(text) % 3 <> 0 THEN 'accepted' ELSE 'rejected' END AS view FROM benchmark"""


@register("u07_judge", U07_SQL)
def u07_judge(spark, sf_dir):
    """A verifier's verdict (stub) and the two views of it."""
    j = INF.judge(dt.table(spark, sf_dir, "benchmark"), "item_id", "text", stubs.verifier_factory)
    ensure = j.select("item_id", "verified", "verdict").checkpoint(eager=True)  # both views come from one call
    _, ok, bad = SH.verdict_split(ensure, F.col("verified"))
    return SH.union_all([SH.tag(ok, view="accepted"), SH.tag(bad, view="rejected")]).select("item_id", "verified", "verdict", "view")


@register("u10_feedback_loop", "SELECT item_id, 9 AS n_messages, 1 AS n_samples FROM benchmark")
def u10_feedback_loop(spark, sf_dir):
    """Four iterations of reply and feedback per item (stubs): the first
    reply lacks a solution, then every second program is right."""
    out = _loop(spark, sf_dir, 4)
    return out.select("item_id", F.size("messages").alias("n_messages"), (F.size("samples") - 1).alias("n_samples"))


def _loop(spark, sf_dir, iterations):
    b = dt.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return AU.feedback_loop(b, "item_id", "text", iterations, stubs.tagged_augmenter_factory, stubs.print_runner_factory, stubs.solver_factory)


U13_SQL = """SELECT item_id, iteration, 'Task ' || CAST(iteration - 1 AS VARCHAR) AS task, CAST(iteration + 2 AS BIGINT) AS final_answer, true AS is_correct
FROM benchmark, (VALUES (2), (4)) t(iteration)"""


@register("u13_flatten_samples", U13_SQL)
def u13_flatten_samples(spark, sf_dir):
    """The samples kept by the loop as rows, checked again."""
    return AU.flatten_samples(_loop(spark, sf_dir, 4), "item_id", stubs.print_runner_factory) \
        .select("item_id", "iteration", "task", "final_answer", "is_correct")


_HQ = "'Now twice. ' || text"
U12_SQL = f"""WITH h AS (SELECT item_id, text, {_HQ} AS question, CAST(length('Q: ' || text) AS VARCHAR) AS answer FROM benchmark
  WHERE exp(-list_avg({_LOGP})) > 2.0),
s AS (SELECT item_id, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS question, answer FROM h)
SELECT item_id, question, answer, round(exp(((length(answer) % 5) + 1) / 4), 6) AS perplexity
FROM s WHERE length('Check: ' || question || ' = ' || answer) % 3 <> 0"""


@register("u12_hard_questions", U12_SQL)
def u12_hard_questions(spark, sf_dir):
    """Improbable items made harder, judged and scored again (stubs)."""
    b = dt.table(spark, sf_dir, "benchmark").select("item_id", F.lit("Read:").alias("question"), F.col("text").alias("answer"))
    ok, _ = AU.hard_questions(b, "item_id", "question", "answer", stubs.scorer_factory, stubs.harder_factory, stubs.verifier_factory,
                              "Q: {answer}", "Check: {question} = {answer}", 2.0)
    return rounded(ok.select("item_id", "question", "answer", "perplexity"))


T21_SQL = f"""WITH {S.RAW_SAMPLES}
SELECT question_id, sample_number, CAST(len(regexp_extract_all(completion, {S.q(P.ANNOTATED_CALC)})) AS BIGINT) AS annotated_calcs,
  {q_text._steps_sql('completion')} AS step_count_v1, {q_text._steps_sql('completion', True)} AS step_count_v2,
  CASE WHEN sample_number = 7 AND question_id % 3 = 0 THEN 'No Answer'
       WHEN contains(lower(completion), {S.q(P.THINK_PHRASE)}) AND length(completion) > 200 AND regexp_matches(lower(completion), {S.q(P.FINAL_PHRASE)}) THEN 'Calculation Error'
       WHEN length(completion) < 150 THEN 'Incomplete Answer'
       WHEN contains(lower(completion), 'approach') AND contains(lower(completion), 'instead') THEN 'Wrong Approach'
       ELSE 'Other Error' END AS error_v1,
  CASE WHEN sample_number = 7 AND question_id % 3 = 0 THEN 'No answer' WHEN length(completion) < 150 THEN 'Incomplete'
       WHEN regexp_matches(completion, {S.q(P.ANSWER_IS_WORD)}) THEN 'Calc error' ELSE 'Other' END AS error_v2
FROM raw_samples"""


@register("t21_completion_features", T21_SQL)
def t21_completion_features(spark, sf_dir):
    """T18, T19, T21-T23 over all completions (some missing)."""
    r = dt.raw_samples(spark, sf_dir)
    some = F.when(~((F.col("sample_number") == 7) & (F.col("question_id") % 3 == 0)), F.col("completion"))
    return r.withColumn("p", some).select(
        "question_id", "sample_number", TX.annotated_calc_count("completion").cast("bigint").alias("annotated_calcs"),
        TX.step_count_v1("completion").cast("bigint").alias("step_count_v1"), TX.step_count_v2("completion").cast("bigint").alias("step_count_v2"),
        TX.error_category_v1("p").alias("error_v1"), TX.error_category_v2("p").alias("error_v2"))


M24_SQL = f"""WITH t AS (SELECT vec_id, len(embedding) - CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 0 END AS n, {S.EMB_LOGP} AS lp FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS position, 'tok' || CAST(i AS VARCHAR) AS token, round(lp[i + 1], 6) AS logprob, round(exp(lp[i + 1]), 6) AS prob,
  n <> len(lp) AS length_mismatch FROM (SELECT *, unnest(range(n)) AS i FROM t)"""


@register("m24_question_tokens", M24_SQL)
def m24_question_tokens(spark, sf_dir):
    """Token tables of all questions; rows whose arrays differ in length are flagged and stop at the shorter."""
    e = dt.table(spark, sf_dir, "embeddings")
    toks = F.transform("embedding", lambda x, i: F.concat(F.lit("tok"), i.cast("string")))
    e = e.select("vec_id", F.slice(toks, F.lit(1), F.size("embedding") - F.when(F.col("vec_id") % 4 == 0, 2).otherwise(0)).alias("tokens"),
                 F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logp"))
    return rounded(M.token_details(e, ["vec_id"], "tokens", None, "logp"))


M18B_SQL = """WITH z AS (SELECT vec_id, list_transform(range(4), lambda k: list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: CAST(x AS DOUBLE) * 4)) AS zs,
    list_transform(range(5), lambda i: (vec_id * 7 + i * 3) % 18) AS ids, vec_id % 3 AS np FROM embeddings),
p AS (SELECT vec_id, unnest(range(greatest(np, 1), 5)) AS i, zs, ids FROM z),
t AS (SELECT vec_id, i, zs[i] AS z, ids[i + 1] AS tok FROM p),
l AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS lse FROM t)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n_tokens, round(sum(CASE WHEN tok < 16 THEN z[tok + 1] - lse END), 6) AS logp_sum,
  round(avg(-list_sum(list_transform(z, lambda x: exp(x - lse) * ln(exp(x - lse) + 1e-12)))), 6) AS mean_entropy FROM l GROUP BY vec_id"""


@register("m18b_sequence_scores", M18B_SQL)
def m18b_sequence_scores(spark, sf_dir):
    """M18/M19 over a token sequence: targets shifted by one, the prompt
    masked, targets outside the vocabulary NULL, mean entropy."""
    e = dt.table(spark, sf_dir, "embeddings")
    zs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", k * 16 + 1, F.lit(16)), lambda x: x.cast("double") * 4))
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("vec_id") * 7 + i * 3) % 18).cast("int"))
    s = M.sequence_scores("zs", "ids", (F.col("vec_id") % 3).cast("int"))
    x = e.select("vec_id", zs.alias("zs"), ids.alias("ids")).select("vec_id", s.alias("s"))
    total = F.aggregate(F.filter("s.logp", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return rounded(x.select("vec_id", F.col("s.n_tokens").alias("n_tokens"),
                            F.when(F.exists("s.logp", lambda v: v.isNotNull()), total).alias("logp_sum"), F.col("s.mean_entropy").alias("mean_entropy")))
