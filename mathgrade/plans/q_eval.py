"""Queries: answer extraction (A), grading and evaluation metrics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from ..operators import metrics as M
from . import driver_tables as dt
from . import evaluate as ev
from . import sql_views as S
from .registry import register, rounded
from .sql_views import GRADED, SAMPLES, pass_at_k_sql

P = A.P

FLAGSHIP_SQL = f"""WITH {GRADED},
pq AS (SELECT question_id, level, count(*) AS n, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS c
       FROM graded GROUP BY question_id, level)
SELECT level, count(*) AS n_questions, CAST(sum(n) AS BIGINT) AS n_samples,
       round(sum(c) / sum(n), 6) AS accuracy,
       round(avg({pass_at_k_sql('n', 'c', 1)}), 6) AS pass_at_1,
       round(avg({pass_at_k_sql('n', 'c', 5)}), 6) AS pass_at_5
FROM pq GROUP BY level"""


@register("m01_pass_at_k_by_level", FLAGSHIP_SQL)
def m01_pass_at_k_by_level(spark, sf_dir):
    return rounded(ev.pass_at_k_by_level(dt.raw_samples(spark, sf_dir), dt.references(spark, sf_dir), ks=(1, 5)))


def _counts(spark, sf_dir):
    """Graded answer counts: one row per (question, extracted answer)."""
    raw = dt.raw_samples(spark, sf_dir)
    return ev.grade_counts(ev.answer_counts(raw), dt.references(spark, sf_dir), tasks=ev.join_tasks(raw))


# --------------------------------------------------------------------------
# A: one query per extraction profile over every sample completion
# --------------------------------------------------------------------------

def _raw(spark, sf_dir):
    return dt.raw_samples(spark, sf_dir)


def _a_query(name, spark_expr, sql_expr, kind="double"):
    sql = f"""WITH {S.RAW_SAMPLES}
SELECT question_id, sample_number, {('round(' + sql_expr + ', 6)') if kind == 'double' else sql_expr} AS pred
FROM raw_samples"""

    @register(name, sql)
    def q(spark, sf_dir):
        return rounded(_raw(spark, sf_dir).select("question_id", "sample_number", spark_expr(F.col("completion"))
                                                  .alias("pred")))
    return q


_a_query("a01_tag_or_hash", A.tag_or_hash,
         "coalesce(" + S.dbl(S.grp("replace(completion, ',', '')", P.TAG_OR_HASH, 1)) + ", "
         + S.dbl(S.grp("replace(completion, ',', '')", P.TAG_OR_HASH, 2)) + ")")
_a_query("a02_six_way", A.six_way, S.six_way_sql("completion"))
_a_query("a03_six_way_reference_compat",
         lambda t: A.six_way(t, fraction="numerator", missing_as_zero=True, strip_commas=False),
         S.six_way_sql("completion", fraction="numerator", missing_as_zero=True, strip_commas=False))
_a_query("a04_ordered_list", A.ordered_list, S.first_pattern_sql("completion", P.ORDERED_LIST))
_a_query("a05_hybrid", A.hybrid, S.hybrid_sql("completion"))
_a_query("a06_boxed_int", lambda t: A.boxed_int(t).cast("bigint"), S.boxed_int_sql("completion"), kind="int")
_a_query("a07_hash_number", A.hash_number, S.dbl("replace(" + S.grp("completion", P.HASH_NUMBER, 1) + ", ',', '')"))
_a_query("a08_hash_phrase_boxed", A.hash_phrase_boxed,
         S.dbl("replace(" + S.grp("completion", P.HASH_PHRASE_BOXED, 1) + ", ',', '')"))
_a_query("a09_hash_text", A.hash_text,
         "nullif(replace(" + S.grp("completion", P.HASH_NUMBER, 1) + ", ',', ''), '')", kind="str")
_a_query("a10_hash_digits", A.hash_digits, S.grp("completion", P.HASH_DIGITS, 1), kind="str")
_a_query("a12_hash_rest_int", A.hash_rest_int,
         f"CASE WHEN regexp_full_match({S.strip_sql(S.grp('completion', P.HASH_REST_OF_LINE, 1))}, '[+-]?\\d+') "
         f"THEN TRY_CAST({S.strip_sql(S.grp('completion', P.HASH_REST_OF_LINE, 1))} AS BIGINT) END", kind="int")
_a_query("a14_after_last_hashes", A.after_last_hashes, S.strip_sql("string_split(completion, '####')[-1]"),
         kind="str")
_a_query("a16_after_last_answer_marker", A.after_last_answer_marker,
         S.strip_sql("string_split(completion, 'Answer:')[-1]"), kind="str")


A11_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id,
  coalesce(CAST(TRY_CAST(list_filter(string_split_regex({S.strip_sql("replace(string_split(" + S.strip_sql('answer') + ", chr(10))[-1], ',', '')")}, '\\s+'),
        lambda x: regexp_full_match(x, '(\\d+\\.?\\d*|\\.\\d+)'))[-1] AS DOUBLE) AS VARCHAR), '') AS final_answer
FROM questions"""


@register("a11_last_line_number", A11_SQL)
def a11_last_line_number(spark, sf_dir):
    """A11 on every reference solution: last numeric token of the last line."""
    return dt.questions(spark, sf_dir).select("question_id", A.last_line_number("answer").alias("final_answer"))


A13_SQL = f"""SELECT doc_id,
  list_transform(regexp_extract_all(text, {S.q(P.NUM_ANY)}), lambda x: round(TRY_CAST(x AS DOUBLE), 6)) AS numbers
FROM documents"""


@register("a13_all_numbers", A13_SQL)
def a13_all_numbers(spark, sf_dir):
    """A13 over whole documents: every number, in order."""
    d = dt.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(A.all_numbers("text"), lambda x: F.round(x, 6)).alias("numbers"))


A15_SQL = f"""WITH {S.RAW_SAMPLES}
SELECT question_id, sample_number,
  {S.dbl(S.grp('completion', P.PROGRAM_NUMBER_SIGNED, 1))} AS program_value
FROM raw_samples"""


@register("a15_program_number", A15_SQL)
def a15_program_number(spark, sf_dir):
    """First (signed) number of each output text."""
    return _raw(spark, sf_dir).select("question_id", "sample_number",
                                      A.program_number("completion").alias("program_value"))


# --------------------------------------------------------------------------
# M: grading rules and per-question metrics
# --------------------------------------------------------------------------

def _pred_sql():
    return f"""WITH {SAMPLES},
p AS (SELECT *, {S.six_way_sql('completion')} AS pred FROM samples)"""


GRADES_SQL = f"""{_pred_sql()}
SELECT question_id, sample_number,
  {S.relative_sql('pred', 'expected_answer')} AS m05_relative,
  coalesce(abs(pred - expected_answer) < 1e-6, false) AS m06_absolute,
  coalesce(abs(pred - TRY_CAST(CAST(expected_answer AS VARCHAR) AS DOUBLE)) < 1e-2, false) AS m07_absolute_text,
  coalesce(pred = expected_answer, false) AS m08_exact,
  coalesce(round(pred, 3) = round(expected_answer, 3), false) AS m09_rounded,
  coalesce(list_bool_or(list_transform(regexp_extract_all(completion, {S.q(P.NUM_ANY)}),
      lambda x: abs(TRY_CAST(x AS DOUBLE) - expected_answer) < greatest(1e-6, abs(expected_answer) * 0.01))), false)
      AS m10_any_number
FROM p"""


@register("m05_grading_rules", GRADES_SQL)
def m05_grading_rules(spark, sf_dir):
    """M5-M10 side by side on every sample."""
    s = dt.samples(spark, sf_dir).withColumn("pred", A.six_way("completion"))
    return s.select(
        "question_id", "sample_number",
        G.relative("pred", "expected_answer").alias("m05_relative"),
        G.absolute("pred", "expected_answer").alias("m06_absolute"),
        G.absolute_text_reference("pred", F.col("expected_answer").cast("string")).alias("m07_absolute_text"),
        G.exact("pred", "expected_answer").alias("m08_exact"),
        G.rounded("pred", "expected_answer").alias("m09_rounded"),
        G.any_number("completion", "expected_answer").alias("m10_any_number"),
    )


PASS_ANY_SQL = f"""WITH {GRADED}
SELECT question_id, bool_or(correct) AS passed, max(CAST(correct AS DOUBLE)) AS pass_at_k,
  CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct_count, count(*) AS attempts,
  round(sum(CAST(correct AS INTEGER)) / count(*) * 100, 6) AS pass_percentage
FROM graded GROUP BY question_id"""


@register("m02_pass_any", PASS_ANY_SQL)
def m02_pass_any(spark, sf_dir):
    """M2/M3 per question."""
    return rounded(M.pass_any(_counts(spark, sf_dir), weight="cnt"))


PQ_SQL = f"""WITH {GRADED}
SELECT question_id, count(*) AS n, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS c,
  round({pass_at_k_sql('count(*)', 'CAST(sum(CAST(correct AS INTEGER)) AS BIGINT)', 1)}, 6) AS pass_at_1,
  round({pass_at_k_sql('count(*)', 'CAST(sum(CAST(correct AS INTEGER)) AS BIGINT)', 3)}, 6) AS pass_at_3,
  round({pass_at_k_sql('count(*)', 'CAST(sum(CAST(correct AS INTEGER)) AS BIGINT)', 10)}, 6) AS pass_at_10
FROM graded GROUP BY question_id"""


@register("m01b_pass_at_k_per_question", PQ_SQL)
def m01b_pass_at_k_per_question(spark, sf_dir):
    """M1 per question for k = 1, 3, 10 (k > n uses k' = n)."""
    return rounded(M.pass_at_k(_counts(spark, sf_dir), ks=(1, 3, 10), weight="cnt"))


DIVERSITY_SQL = f"""{_pred_sql()},
g AS (SELECT *, {S.relative_sql('pred', 'expected_answer')} AS correct FROM p)
SELECT question_id, round(avg(CAST(correct AS DOUBLE)), 6) AS correct_fraction,
  count(DISTINCT pred) AS answer_diversity
FROM g GROUP BY question_id"""


@register("m04_correct_fraction_diversity", DIVERSITY_SQL)
def m04_correct_fraction_diversity(spark, sf_dir):
    """Mean correctness and distinct extracted answers per question."""
    return rounded(M.correct_fraction_and_diversity(_counts(spark, sf_dir), "pred", weight="cnt"))


SELECT_SQL = f"""{_pred_sql()},
g AS (SELECT *, {S.relative_sql('pred', 'expected_answer')} AS correct FROM p)
SELECT question_id,
  coalesce(min(sample_number) FILTER (WHERE correct), min(sample_number)) AS chosen_sample,
  min(sample_number) FILTER (WHERE correct) IS NOT NULL AS is_correct_present,
  round(arg_min(pred, struct_pack(s := sample_number, p := pred)) FILTER (WHERE correct), 6) AS correct_answer
FROM g GROUP BY question_id"""


@register("m11_select_sample", SELECT_SQL)
def m11_select_sample(spark, sf_dir):
    """First correct sample else the first; the correct answer."""
    return rounded(M.select_sample(_counts(spark, sf_dir), answer="pred"))


NOVELTY_SQL = f"""WITH {GRADED}
SELECT question_id, round(1 - sum(CAST(correct AS INTEGER)) / 8.0, 6) AS novelty
FROM graded GROUP BY question_id"""


@register("m12_novelty_by_failure", NOVELTY_SQL)
def m12_novelty_by_failure(spark, sf_dir):
    """1 - correct / 8 with the denominator fixed at the sample size."""
    return rounded(M.novelty_by_failure(_counts(spark, sf_dir), sample_size=8, weight="cnt"))


VOTING_SQL = f"""{_pred_sql()},
a AS (SELECT question_id, CAST(pred + 0 AS VARCHAR) AS answer FROM p),
c AS (SELECT question_id, answer, count(*) AS cnt FROM a GROUP BY ALL),
t AS (SELECT question_id, sum(cnt) AS total, count(*) AS k FROM c GROUP BY question_id)
SELECT question_id, t.k AS answer_diversity,
  round(CASE WHEN t.k <= 1 THEN 0.0 ELSE -sum((cnt / total) * ln(cnt / total)) END, 6) AS voting_entropy
FROM c JOIN t USING (question_id) GROUP BY question_id, t.k, t.total"""


@register("m21_voting_entropy", VOTING_SQL)
def m21_voting_entropy(spark, sf_dir):
    """Entropy of the extracted answers per question (NULL answer
    counts as its own value)."""
    return rounded(M.voting_entropy_of_counts(ev.answer_counts(dt.raw_samples(spark, sf_dir))))


EXPECTED_SQL = f"""WITH {GRADED},
pq AS (SELECT question_id, level, count(*) AS n, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS c
       FROM graded GROUP BY question_id, level),
x AS (SELECT level, nn AS n_augmented, {pass_at_k_sql('n', 'c', 'nn')} AS p
      FROM pq, (SELECT unnest([1, 2, 3, 5]) AS nn))
SELECT level, n_augmented, round(avg(p), 6) AS expected_pass_at_1,
  round(sqrt(sum(p * (1 - p))) / count(*), 6) AS std_pass_at_1, count(*) AS n_questions
FROM x GROUP BY level, n_augmented"""


@register("m25_expected_pass_with_n", EXPECTED_SQL)
def m25_expected_pass_with_n(spark, sf_dir):
    """Expected pass@1 with n answers per level (closed form)."""
    pq = M.per_question(_counts(spark, sf_dir), carry=("level",), weight="cnt")
    out = M.expected_pass_with_n(pq, [1, 2, 3, 5], group=("level",))
    return rounded(out.withColumn("n_augmented", F.col("n_augmented").cast("int")))


# --------------------------------------------------------------------------
# Token-array metrics on embeddings (rows = token vectors)
# --------------------------------------------------------------------------

SEQ_SQL = f"""SELECT vec_id,
  round(list_sum({S.EMB_LOGP}), 6) AS logp_sum,
  round(list_sum({S.EMB_LOGP}) / len(embedding), 6) AS avg_logp,
  round(exp(-list_sum({S.EMB_LOGP}) / len(embedding)), 6) AS perplexity,
  CAST(len(embedding) AS INTEGER) AS n_tokens,
  round(list_min({S.EMB_LOGP}), 6) AS min_logprob,
  round(list_stddev_samp({S.EMB_LOGP}), 6) AS std_logprob,
  round(exp(-list_avg(({S.EMB_LOGP})[-(len(embedding) - 16):])), 6) AS answer_difficulty,
  round(coalesce(list_sum({S.EMB_LOGP}), 0.0), 6) AS novelty_logp
FROM embeddings"""


@register("m16_sequence_logp", SEQ_SQL)
def m16_sequence_logp(spark, sf_dir):
    """M13-M17 on per-token log-prob arrays (embedding values as -|x|);
    answer difficulty over the tokens after a 16-token prompt."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logp"))
    s = M.sequence_logp("logp")
    st = M.token_stats("logp")
    return rounded(e.select("vec_id", s["logp_sum"].alias("logp_sum"), s["avg_logp"].alias("avg_logp"),
                            s["perplexity"].alias("perplexity"), s["n_tokens"].alias("n_tokens"),
                            st["min_logprob"].alias("min_logprob"), st["std_logprob"].alias("std_logprob"),
                            M.answer_difficulty("logp", F.lit(16)).alias("answer_difficulty"),
                            M.summed_logp_or_zero("logp").alias("novelty_logp")))


SOFTMAX_SQL = """WITH z AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 4) AS logits
                   FROM embeddings),
l AS (SELECT vec_id, label, logits, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse
      FROM z)
SELECT vec_id, round(logits[label + 1] - lse, 6) AS target_logp,
  round(-list_sum(list_transform(logits, lambda x: exp(x - lse) * ln(exp(x - lse) + 1e-12))), 6) AS token_entropy
FROM l"""


@register("m18_logsoftmax_gather_entropy", SOFTMAX_SQL)
def m18_logsoftmax_gather_entropy(spark, sf_dir):
    """Log-softmax of logits, log p of the target id, entropy."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 4).alias("logits"))
    return rounded(e.select("vec_id", M.gather_logp("logits", "label").alias("target_logp"),
                            M.distribution_entropy("logits").alias("token_entropy")))


CE_SQL = f"""WITH t AS (
  SELECT label AS step, unnest({S.EMB_LOGP}) AS logp, unnest(generate_series(0, len(embedding) - 1)) AS pos
  FROM embeddings),
m AS (SELECT step, logp, CASE WHEN pos < 8 THEN -100 ELSE 1 END AS lab FROM t)
SELECT step, round(avg(-logp) FILTER (WHERE lab <> -100), 6) AS mean_loss,
  round(sum(-logp) FILTER (WHERE lab <> -100), 6) AS sum_loss,
  count(*) FILTER (WHERE lab <> -100) AS n_tokens
FROM m GROUP BY step"""


@register("m20_masked_cross_entropy", CE_SQL)
def m20_masked_cross_entropy(spark, sf_dir):
    """Masked mean token loss per step (label = checkpoint step; the
    first 8 positions are prompt and masked)."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("step"),
        F.posexplode(F.transform("embedding", lambda x: -F.abs(x.cast("double")))).alias("pos", "logp"))
    e = e.withColumn("label", F.when(F.col("pos") < 8, F.lit(-100)).otherwise(F.lit(1)))
    return rounded(M.masked_cross_entropy(e, keys=("step",)))


TOKENS_SQL = f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS position, 'tok' || CAST(pos - 1 AS VARCHAR) AS token,
  CAST(pos - 1 AS INTEGER) AS token_id, round(lp, 6) AS logprob, round(exp(lp), 6) AS prob, false AS length_mismatch
FROM (SELECT vec_id, unnest({S.EMB_LOGP}) AS lp, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)"""


@register("m23_token_details", TOKENS_SQL)
def m23_token_details(spark, sf_dir):
    """One row per token with prob = exp(logprob) and a length check."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x, i: F.concat(F.lit("tok"), i.cast("string"))).alias("tokens"),
        F.transform("embedding", lambda x, i: i).alias("ids"),
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logp"))
    return rounded(M.token_details(e, ["vec_id"], "tokens", "ids", "logp"))
