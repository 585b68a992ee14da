"""Queries: text parsing and features (T) and training-data shaping (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import patterns as P
from ..functions import text as TX
from ..operators import training as D
from . import driver_tables as dt
from . import sql_views as S
from .registry import register, rounded

WS = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# --------------------------------------------------------------------------
# Rendered candidate replies (from benchmark items): tagged blocks, some with
# a bare fence instead of a code tag, some without a solution block.
# --------------------------------------------------------------------------

def candidates(spark, sf_dir):
    b = dt.table(spark, sf_dir, "benchmark")
    n = (F.col("item_id") % 97).cast("string")
    code = F.concat(F.lit("```python\nprint("), n, F.lit(")\n```"))
    sol = F.concat(F.lit("<solution>Work it out.\n#### "), n, F.lit(" <answer>"), n, F.lit("</answer> again <answer>0</answer></solution>"))
    reply = (F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("<task>"), F.col("text"), F.lit("</task>\n"), sol, F.lit("\n"), code))
             .when(F.col("item_id") % 3 == 1, F.concat(F.lit("<task>"), F.col("text"), F.lit("</task>\n"), sol,
                                                       F.lit("\n<code>\n"), code, F.lit("\n</code>")))
             .otherwise(F.concat(F.lit("<task> "), F.col("text"), F.lit(" </task>\n<code>"), code, F.lit("</code>"))))
    return b.select("item_id", reply.alias("reply"))


CANDIDATES_SQL = """candidates AS (
  SELECT item_id, CASE
    WHEN item_id % 3 = 0 THEN '<task>' || text || '</task>' || chr(10) || '<solution>Work it out.' || chr(10) || '#### ' || CAST(item_id % 97 AS VARCHAR) || ' <answer>' || CAST(item_id % 97 AS VARCHAR) || '</answer> again <answer>0</answer></solution>' || chr(10) || '```python' || chr(10) || 'print(' || CAST(item_id % 97 AS VARCHAR) || ')' || chr(10) || '```'
    WHEN item_id % 3 = 1 THEN '<task>' || text || '</task>' || chr(10) || '<solution>Work it out.' || chr(10) || '#### ' || CAST(item_id % 97 AS VARCHAR) || ' <answer>' || CAST(item_id % 97 AS VARCHAR) || '</answer> again <answer>0</answer></solution>' || chr(10) || '<code>' || chr(10) || '```python' || chr(10) || 'print(' || CAST(item_id % 97 AS VARCHAR) || ')' || chr(10) || '```' || chr(10) || '</code>'
    ELSE '<task> ' || text || ' </task>' || chr(10) || '<code>```python' || chr(10) || 'print(' || CAST(item_id % 97 AS VARCHAR) || ')' || chr(10) || '```</code>'
  END AS reply FROM benchmark)"""


def _strip(x):
    return S.strip_sql(x)


T01_SQL = f"""WITH {CANDIDATES_SQL},
b AS (SELECT item_id,
  CASE WHEN regexp_matches(reply, {S.q(P.CODE_BLOCK)}) THEN {_strip(f"regexp_extract(reply, {S.q(P.CODE_BLOCK)}, 1)")}
       ELSE {_strip(f"regexp_extract_all(reply, {S.q(P.PYTHON_FENCE)}, 1)[-1]")} END AS code,
  CASE WHEN regexp_matches(reply, {S.q(P.TASK_BLOCK)}) THEN {_strip(f"regexp_extract(reply, {S.q(P.TASK_BLOCK)}, 1)")} END AS task,
  CASE WHEN regexp_matches(reply, {S.q(P.SOLUTION_BLOCK)}) THEN {_strip(f"regexp_extract(reply, {S.q(P.SOLUTION_BLOCK)}, 1)")} END AS solution
  FROM candidates)
SELECT item_id, code, task, solution, (code IS NOT NULL AND task IS NOT NULL AND solution IS NOT NULL) AS format_ok FROM b"""


@register("t01_extract_blocks", T01_SQL)
def t01_extract_blocks(spark, sf_dir):
    """Code / task / solution blocks with a format flag."""
    c = candidates(spark, sf_dir)
    return c.select("item_id", TX.extract_blocks("reply").alias("b")).select("item_id", "b.*")


T02_SQL = f"""WITH {CANDIDATES_SQL}
SELECT item_id,
  CASE WHEN regexp_matches(reply, {S.q(P.CODE_BLOCK_LENIENT)})
       THEN {_strip(f"regexp_replace(regexp_extract(reply, {S.q(P.CODE_BLOCK_LENIENT)}, 1), '^```python\\s*', '')")}
       ELSE coalesce({_strip(f"regexp_extract_all(reply, {S.q(P.PYTHON_FENCE)}, 1)[-1]")}, '') END AS code,
  CASE WHEN regexp_matches(reply, {S.q(P.TASK_BLOCK_CS)}) THEN regexp_replace(regexp_extract(reply, {S.q(P.TASK_BLOCK_CS)}, 1), '^[ \\n]+|[ \\n]+$', '', 'g') ELSE '' END AS task,
  CASE WHEN regexp_matches(reply, {S.q(P.SOLUTION_BLOCK_CS)}) THEN regexp_replace(regexp_extract(reply, {S.q(P.SOLUTION_BLOCK_CS)}, 1), '^[ \\n]+|[ \\n]+$', '', 'g') ELSE '' END AS solution
FROM candidates"""


@register("t02_extract_blocks_lenient", T02_SQL)
def t02_extract_blocks_lenient(spark, sf_dir):
    """Lenient blocks, missing -> ''."""
    c = candidates(spark, sf_dir)
    return c.select("item_id", TX.extract_blocks_lenient("reply").alias("b")).select("item_id", "b.*")


T07_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id, regexp_replace(answer, '####\\s*(\\d+)', '\\\\boxed{{\\1}}', 'g') AS answer_boxed
FROM questions"""


@register("t07_hash_to_boxed", T07_SQL)
def t07_hash_to_boxed(spark, sf_dir):
    """T7: '#### n' -> '\\boxed{n}' on every reference solution."""
    return dt.questions(spark, sf_dir).select("question_id", TX.hash_to_boxed("answer").alias("answer_boxed"))


def verifier_replies(spark, sf_dir):
    b = dt.table(spark, sf_dir, "benchmark")
    verdict = F.when(F.col("item_id") % 2 == 0, F.lit("True")).otherwise(F.lit("False"))
    return b.select("item_id", F.concat(
        F.lit("Harder Question: "), F.col("text"), F.lit("\nHarder Answer: It is "), (F.col("item_id") * 3).cast("string"),
        F.lit(".\nVerification Result: "), verdict, F.lit("\nMath Solution: "), (F.col("item_id") * 3).cast("string"),
        F.lit(" apples [["), F.when(F.col("item_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")), F.lit("]]")
    ).alias("reply"))


T08_SQL = f"""WITH r AS (
  SELECT item_id, 'Harder Question: ' || text || chr(10) || 'Harder Answer: It is ' || CAST(item_id * 3 AS VARCHAR) || '.' || chr(10)
    || 'Verification Result: ' || CASE WHEN item_id % 2 = 0 THEN 'True' ELSE 'False' END || chr(10) || 'Math Solution: '
    || CAST(item_id * 3 AS VARCHAR) || ' apples [[' || CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END || ']]' AS reply
  FROM benchmark)
SELECT item_id,
  {_strip(S.grp('reply', P.HARDER_QUESTION, 1))} AS question,
  {_strip(S.grp('reply', P.HARDER_ANSWER, 1))} AS answer,
  coalesce(contains(reply, 'Verification Result: True'), false) AS verified,
  {_strip(S.grp('reply', P.MATH_SOLUTION, 1))} AS math_solution,
  {S.grp('reply', r'\[\[([AB])\]\]', 1)} AS verdict
FROM r"""


@register("t08_verifier_fields", T08_SQL)
def t08_verifier_fields(spark, sf_dir):
    """Harder question/answer, verification flag, math solution, judge verdict."""
    r = verifier_replies(spark, sf_dir)
    qa = TX.harder_question_answer("reply")
    return r.select("item_id", qa["question"].alias("question"), qa["answer"].alias("answer"),
                    TX.verification_passed("reply").alias("verified"), TX.math_solution("reply").alias("math_solution"),
                    TX.judge_verdict("reply").alias("verdict"))


T12_SQL = """WITH c AS (SELECT conv_id, turn, 'User ' || CAST(conv_id AS VARCHAR) || ' asks: ' AS prompt, text FROM conversations),
d AS (SELECT conv_id, turn, prompt, CASE WHEN turn % 2 = 0 THEN prompt || text ELSE text END AS completion FROM c)
SELECT conv_id, turn,
  regexp_replace(CASE WHEN starts_with(completion, prompt) THEN substr(completion, length(prompt) + 1) ELSE completion END,
                 '^\\s+|\\s+$', '', 'g') AS answer,
  regexp_replace(string_split('x<|im_start|>assistant' || completion, '<|im_start|>assistant')[-1], '^\\s+|\\s+$', '', 'g') AS after_marker
FROM d"""


@register("t12_strip_prompt", T12_SQL)
def t12_strip_prompt(spark, sf_dir):
    """Drop an echoed prompt; text after the last assistant marker."""
    c = dt.table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit("User "), F.col("conv_id").cast("string"), F.lit(" asks: "))
    comp = F.when(F.col("turn") % 2 == 0, F.concat(prompt, F.col("text"))).otherwise(F.col("text"))
    d = c.select("conv_id", "turn", prompt.alias("prompt"), comp.alias("completion"))
    return d.select("conv_id", "turn", TX.strip_prompt("completion", "prompt").alias("answer"),
                    TX.after_last_assistant(F.concat(F.lit("x" + P.ASSISTANT_TAG), F.col("completion"))).alias("after_marker"))


T13_SQL = f"""WITH {S.QUESTIONS}
SELECT b.item_id,
  replace(replace('Question: {{question}}' || chr(10) || 'Worked answer: {{answer}}' || chr(10) || '100% sure? Answer:', '{{question}}', b.text), '{{answer}}', coalesce(q.answer, '')) AS prompt,
  concat_ws(chr(10), {_strip('b.text')}, {_strip("coalesce(q.answer, '')")}, 'Answer: ' || {_strip("string_split(coalesce(q.answer, ''), '####')[-1]")}) AS training_text
FROM benchmark b LEFT JOIN questions q ON q.question_id = b.item_id"""


@register("t13_render_prompt", T13_SQL)
def t13_render_prompt(spark, sf_dir):
    """Template rendering by literal replacement and training text."""
    b = dt.table(spark, sf_dir, "benchmark")
    q = dt.questions(spark, sf_dir).select(F.col("question_id").alias("item_id"), "answer")
    j = b.join(q, "item_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    tpl = "Question: {question}\nWorked answer: {answer}\n100% sure? Answer:"
    return j.select("item_id", TX.render_prompt(tpl, question="text", answer="answer").alias("prompt"),
                    TX.training_text("text", "answer").alias("training_text"))


def _steps_sql(t, single=False):
    lo = f"lower({t})"
    nl = f"(length({t}) - length(replace({t}, chr(10), '')))"
    if single:
        hits = f"len(regexp_extract_all({lo}, {S.q(P.STEP_ALTERNATION)}))"
    else:
        hits = " + ".join(f"len(regexp_extract_all({lo}, {S.q(p)}))" for p in P.STEP_WORDS)
    return f"CAST(CASE WHEN ({hits}) > 0 THEN ({hits}) ELSE {nl} + 1 END AS BIGINT)"


T15_SQL = f"""SELECT doc_id,
  CAST(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')) AS BIGINT) AS word_count,
  CAST(length(text) - length(translate(text, '+-*/', '')) AS BIGINT) AS operator_count,
  CAST(length(text) AS BIGINT) AS char_length,
  {_steps_sql('text')} AS step_count_v1,
  {_steps_sql('text', True)} AS step_count_v2,
  CAST(len(regexp_extract_all(text, {S.q(P.ANNOTATED_CALC)})) AS BIGINT) AS annotated_calcs,
  CASE WHEN text IS NULL THEN 'No Answer'
       WHEN contains(lower(text), {S.q(P.THINK_PHRASE)}) AND length(text) > 200 AND regexp_matches(lower(text), {S.q(P.FINAL_PHRASE)}) THEN 'Calculation Error'
       WHEN length(text) < 150 THEN 'Incomplete Answer'
       WHEN contains(lower(text), 'approach') AND contains(lower(text), 'instead') THEN 'Wrong Approach'
       ELSE 'Other Error' END AS error_v1,
  CASE WHEN text IS NULL THEN 'No answer' WHEN length(text) < 150 THEN 'Incomplete'
       WHEN regexp_matches(text, {S.q(P.ANSWER_IS_WORD)}) THEN 'Calc error' ELSE 'Other' END AS error_v2
FROM documents"""


@register("t15_text_features", T15_SQL)
def t15_text_features(spark, sf_dir):
    """T15-T19, T21-T23 over whole documents."""
    d = dt.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.word_count("text").cast("bigint").alias("word_count"),
                    TX.operator_count("text").cast("bigint").alias("operator_count"),
                    TX.char_length("text").cast("bigint").alias("char_length"),
                    TX.step_count_v1("text").cast("bigint").alias("step_count_v1"),
                    TX.step_count_v2("text").cast("bigint").alias("step_count_v2"),
                    TX.annotated_calc_count("text").cast("bigint").alias("annotated_calcs"),
                    TX.error_category_v1("text").alias("error_v1"), TX.error_category_v2("text").alias("error_v2"))


def _mean_steps_sql(single):
    return f"list_avg(list_transform(string_split(text, chr(10)), lambda x: {_steps_sql('x', single)}))"


T20_SQL = f"""SELECT doc_id, round({_mean_steps_sql(False)}, 6) AS mean_steps_v1, round({_mean_steps_sql(True)}, 6) AS mean_steps_v2
FROM documents"""


@register("t20_mean_steps", T20_SQL)
def t20_mean_steps(spark, sf_dir):
    """Mean step count over a list of answers (the lines of each
    document), both versions."""
    d = dt.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("answers"))
    return rounded(d.select("doc_id", TX.mean_steps("answers", 1).alias("mean_steps_v1"), TX.mean_steps("answers", 2).alias("mean_steps_v2")))


T24_SQL = f"""WITH {S.QUESTIONS}, {S.RAW_SAMPLES.replace('AS completion', 'AS completion, l_tax, l_discount')},
p AS (SELECT question_id, sample_number, l_tax, l_discount, {S.six_way_sql('completion')} AS pred FROM raw_samples),
g AS (SELECT *, {S.relative_sql('pred', 'expected_answer')} AS correct FROM p JOIN questions USING (question_id))
SELECT question_id, sample_number,
  CASE WHEN (l_tax * 100) < 3 THEN 'too_few_steps'
       WHEN NOT correct THEN 'incorrect_code'
       WHEN abs(l_discount * 10) < 0.3 THEN 'too_low_novelty'
       WHEN abs(l_tax * 10) < 0.2 THEN 'too_low_difficulty'
       ELSE 'accepted' END AS reason
FROM g"""


@register("t24_candidate_reason", T24_SQL)
def t24_candidate_reason(spark, sf_dir):
    """Verdict chain with step, novelty and difficulty thresholds."""
    from . import evaluate as ev
    g = ev.extracted(dt.raw_samples(spark, sf_dir, "l_tax", "l_discount")).join(dt.references(spark, sf_dir), "question_id")
    reason = TX.candidate_reason(G.relative("pred", "expected_answer"), F.col("l_discount") * 10, F.col("l_tax") * 10, 0.3, 0.2,
                                 step_count=F.col("l_tax") * 100, step_target=2)
    return g.select("question_id", "sample_number", reason.alias("reason"))


# --------------------------------------------------------------------------
# D: chat examples, ChatML, tokens, masks, split
# --------------------------------------------------------------------------

SYSTEM = "Solve the problem and end with the final answer."

D01_SQL = f"""WITH {S.QUESTIONS}
SELECT b.item_id, [
  {{'role': 'system', 'content': '{SYSTEM}'}},
  {{'role': 'user', 'content': {_strip('b.text')}}},
  {{'role': 'assistant', 'content': {_strip('q.answer')} || chr(10) || chr(10) || 'The final answer is: <answer> ' ||
     coalesce(CAST(TRY_CAST(list_filter(string_split_regex({_strip("replace(string_split(" + _strip('q.answer') + ", chr(10))[-1], ',', '')")}, '\\s+'),
        lambda x: regexp_full_match(x, '(\\d+\\.?\\d*|\\.\\d+)'))[-1] AS DOUBLE) AS VARCHAR), '') || ' </answer>'}}
  ] AS messages
FROM benchmark b JOIN questions q ON q.question_id = b.item_id"""


@register("d01_chat_examples", D01_SQL)
def d01_chat_examples(spark, sf_dir):
    """System / user / assistant messages with the final-answer line."""
    b = dt.table(spark, sf_dir, "benchmark")
    q = dt.questions(spark, sf_dir).select(F.col("question_id").alias("item_id"), "answer")
    j = b.join(q, "item_id")
    return j.select("item_id", D.chat_example("text", "answer", SYSTEM).alias("messages"))


CHATML_SQL = """SELECT conv_id,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS chat_text
FROM conversations GROUP BY conv_id"""


def _chat_text(spark, sf_dir):
    msgs = D.conversation_messages(dt.table(spark, sf_dir, "conversations"))
    return msgs.select("conv_id", D.chatml("messages").alias("chat_text"))


@register("d02_chatml", CHATML_SQL)
def d02_chatml(spark, sf_dir):
    """Ordered turns -> ChatML text with a generation prompt."""
    return _chat_text(spark, sf_dir)


def _pieces_sql(t):
    return f"regexp_extract_all({t}, '<\\|im_start\\|>|<\\|im_end\\|>|[^\\s<]+|<')"


def _ids_sql(t):
    return (f"list_transform({_pieces_sql(t)}, lambda p: CASE WHEN p = '<|im_start|>' THEN 1 WHEN p = '<|im_end|>' THEN 2 "
            f"ELSE CAST((('0x' || substr(md5(p), 1, 8))::BIGINT % 49997) + 3 AS INTEGER) END)")


D03_SQL = f"""WITH c AS ({CHATML_SQL}),
t AS (SELECT conv_id, chat_text, {_ids_sql('chat_text')} AS ids FROM c),
p AS (SELECT conv_id, chat_text, ids[1:1024] AS kept, len(ids[1:1024]) AS n FROM t),
m AS (SELECT conv_id, chat_text, kept || list_transform(range(1024 - n), lambda x: 0) AS input_ids,
        list_transform(range(n), lambda x: 1) || list_transform(range(1024 - n), lambda x: 0) AS attention_mask, n,
        len({_pieces_sql("string_split(chat_text, '<|im_start|>assistant')[1]")}) AS n_prefix
      FROM p),
k AS (SELECT *, coalesce(list_filter(list_transform(input_ids, lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda v: v IS NOT NULL)[3], 0) + 1 AS cut4,
        CASE WHEN list_position(input_ids, 2) > 0 THEN list_position(input_ids, 2) ELSE 0 END AS cut6 FROM m)
SELECT conv_id, input_ids, attention_mask,
  list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < cut4 OR attention_mask[i] = 0 THEN -100 ELSE x END) AS labels_v1,
  list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < n_prefix + 1 OR attention_mask[i] = 0 THEN -100 ELSE x END) AS labels_v2,
  list_transform(input_ids, lambda x, i: CASE WHEN i - 1 < cut6 OR attention_mask[i] = 0 THEN -100 ELSE x END) AS labels_v3
FROM k"""


@register("d03_tokenise_and_mask", D03_SQL)
def d03_tokenise_and_mask(spark, sf_dir):
    """Native tokens, truncate/pad to D.MAX_LENGTH (1,024), three label-mask variants
    (padding masked too)."""
    c = _chat_text(spark, sf_dir)
    ids = D.piece_ids(D.whitespace_pieces("chat_text"))
    x = c.withColumn("enc", D.pad_truncate(ids)).select(
        "conv_id", "chat_text", "enc.input_ids", "enc.attention_mask")
    return x.select(
        "conv_id", "input_ids", "attention_mask",
        D.mask_third_marker("input_ids", "attention_mask", marker_id=1).alias("labels_v1"),
        D.mask_prefix_count("input_ids", D.prefix_token_count("chat_text"), "attention_mask").alias("labels_v2"),
        D.mask_before_marker("input_ids", 2, "attention_mask").alias("labels_v3"))


D07_SQL = """SELECT o_orderkey, CASE WHEN (('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000) < 500
  THEN 'validation' ELSE 'train' END AS split FROM orders"""


@register("d07_train_validation_split", D07_SQL)
def d07_train_validation_split(spark, sf_dir):
    """Stable 5 % validation split by key hash."""
    o = dt.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.split_label("o_orderkey", 0.05, 42).alias("split"))
