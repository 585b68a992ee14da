"""Evaluation metrics (M1-M4, M11-M26) as DataFrame operators.

Per-question metrics are hash aggregates keyed on the question id (partial
aggregation map-side, so a question holding a third of all samples still
shuffles only one partial row per task). Per-row metrics over token arrays
are higher-order functions (``aggregate``/``transform``): interpreted, but in
the JVM, and linear in the array because shared values are bound once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import once


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# M1 pass@k and friends
# --------------------------------------------------------------------------

def pass_at_k_expr(n, c, k) -> Column:
    """Unbiased pass@k: with k' = min(k, n): 0 if c = 0, else
    1 - C(n-c, k') / C(n, k') = 1 - prod_{i=n-c+1..n} (1 - k'/i).
    The product form never forms a binomial coefficient, so it is exact for
    any n; when n - c < k' a factor is 0 and the result is 1."""
    n, c = _col(n), _col(c)
    kk = F.least(k if isinstance(k, Column) else F.lit(k), n)
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - kk / i))
    return F.when(c == 0, F.lit(0.0)).otherwise(1 - prod)


def _right(correct: str, weight: str | None) -> Column:
    """Correct samples of a row: 1 or 0, or the row's weight if it stands for several."""
    w = F.lit(1) if weight is None else F.col(weight)
    return F.sum(F.when(F.coalesce(F.col(correct), F.lit(False)), w).otherwise(0)).cast("bigint")


def _size(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")


def per_question(graded: DataFrame, keys: Sequence[str] = ("question_id",),
                 correct: str = "correct", carry: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n samples and c correct per question (one hash aggregate). ``weight``
    names a count when rows are pre-aggregated (question, answer) pairs.
    ``carry`` columns depend on the key (e.g. level) and ride along as an
    aggregate, so the group-by needs only the join's key distribution and
    no extra shuffle."""
    return graded.groupBy(*keys).agg(
        _size(weight).alias("n"),
        _right(correct, weight).alias("c"),
        *[F.max(c).alias(c) for c in carry],
    )


def pass_at_k(graded: DataFrame, ks: Sequence[int] = (1,), keys: Sequence[str] = ("question_id",),
              correct: str = "correct", carry: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M1 per question: columns n, c, pass_at_{k} for each k."""
    pq = per_question(graded, keys, correct, carry, weight)
    return pq.select(*keys, *carry, "n", "c", *[pass_at_k_expr("n", "c", k).alias(f"pass_at_{k}") for k in ks])


def pass_any(graded: DataFrame, keys: Sequence[str] = ("question_id",), correct: str = "correct",
             carry: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M2/M3: passed (any correct), pass_at_k as 1.0/0.0, correct_count,
    attempts and pass_percentage = correct_count / attempts * 100."""
    return graded.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carry],
        F.max(F.col(correct).cast("int")).cast("boolean").alias("passed"),
        F.max(F.col(correct).cast("double")).alias("pass_at_k"),
        _right(correct, weight).alias("correct_count"),
        _size(weight).alias("attempts"),
    ).withColumn("pass_percentage", F.col("correct_count") / F.col("attempts") * 100)


def correct_fraction_and_diversity(graded: DataFrame, answer: str, keys=("question_id",),
                                   correct: str = "correct", weight: str | None = None) -> DataFrame:
    """Mean correctness and number of distinct answers per question."""
    return graded.groupBy(*keys).agg(
        (_right(correct, weight) / _size(weight)).alias("correct_fraction"),
        F.countDistinct(answer).alias("answer_diversity"),
    )


# --------------------------------------------------------------------------
# M11 sample selection, M12 novelty by failure, M21 voting entropy
# --------------------------------------------------------------------------

def select_sample(graded: DataFrame, keys=("question_id",), sample: str = "sample_number",
                  correct: str = "correct", answer: str | None = None) -> DataFrame:
    """First correct sample, else the first sample. ``is_correct_present``
    and the chosen sample's answer (NULL when no sample is correct)."""
    first_ok = F.min(F.when(F.col(correct), F.col(sample)))
    aggs = [F.coalesce(first_ok, F.min(sample)).alias("chosen_sample"),
            first_ok.isNotNull().alias("is_correct_present")]
    if answer:
        # of samples with the same number, the smallest answer
        aggs.append(F.min_by(F.col(answer), F.when(F.col(correct), F.struct(sample, answer))).alias("correct_answer"))
    return graded.groupBy(*keys).agg(*aggs)


def novelty_by_failure(graded: DataFrame, sample_size: int = 8, keys=("question_id",),
                       correct: str = "correct", weight: str | None = None) -> DataFrame:
    """1 - correct / sample_size; the denominator stays fixed even when
    fewer samples came back (failed calls count as wrong)."""
    return graded.groupBy(*keys).agg(
        (1 - _right(correct, weight) / F.lit(float(sample_size))).alias("novelty"))


def voting_entropy(answers: DataFrame, keys=("question_id",), answer: str = "answer") -> DataFrame:
    """Entropy (natural log) of the answer distribution per question;
    unanimous or empty gives 0. Two aggregates on (q, answer) then q; both are
    partial-aggregated, so a hot question does not pin one task."""
    return voting_entropy_of_counts(answers.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("cnt")), keys)


def voting_entropy_of_counts(counts: DataFrame, keys=("question_id",)) -> DataFrame:
    """M21/M22 from one row per (question, answer) with its ``cnt``."""
    per_q = counts.groupBy(*keys).agg(
        F.sum("cnt").alias("total"),
        F.count(F.lit(1)).alias("answer_diversity"),
        F.sum(F.col("cnt") * F.log(F.col("cnt"))).alias("s_clogc"),
    )
    # H = ln(N) - sum(c ln c) / N
    h = F.log(F.col("total")) - F.col("s_clogc") / F.col("total")
    return per_q.select(*keys, "answer_diversity",
                        F.when(F.col("answer_diversity") <= 1, F.lit(0.0)).otherwise(h).alias("voting_entropy"))


# --------------------------------------------------------------------------
# Token-array metrics: M13-M20, M23, M24
# --------------------------------------------------------------------------

def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def sequence_logp(logp) -> Column:
    """struct(logp_sum, avg_logp, perplexity, n_tokens) of a log-prob array.
    Empty arrays give NULL averages (the reference would divide by zero)."""
    a = _col(logp)
    n = F.size(a)
    s = _sum(a)
    avg = F.when(n > 0, s / n)
    return F.struct(s.alias("logp_sum"), avg.alias("avg_logp"),
                    F.exp(-avg).alias("perplexity"), n.alias("n_tokens"))


def token_stats(logp) -> Column:
    """Mean, min, sum and sample std of token log-probs in one row."""
    a = _col(logp)
    n = F.size(a)

    def from_sum(s):
        return once(F.when(n > 0, s / n), lambda mean: F.struct(
            mean.alias("mean_logprob"), F.array_min(a).alias("min_logprob"), s.alias("sum_logprob"),
            F.when(n > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / (n - 1))).alias("std_logprob")))
    return once(_sum(a), from_sum)


def perplexity(logp) -> Column:
    """exp(-mean log p) over the returned tokens."""
    a = _col(logp)
    return F.when(F.size(a) > 0, F.exp(-_sum(a) / F.size(a)))


def summed_logp_or_zero(logp) -> Column:
    """Summed log-prob, failure (NULL array) -> 0."""
    return F.coalesce(_sum(_col(logp)), F.lit(0.0))


def answer_difficulty(full_logp, n_prompt_tokens) -> Column:
    """Perplexity of the last m tokens, m = len(full) - n_prompt."""
    a = _col(full_logp)
    m = F.size(a) - _col(n_prompt_tokens)
    tail = F.when(m > 0, F.slice(a, -m, m))
    return perplexity(tail)


def _log_sum_exp(z: Column, fn) -> Column:
    """Apply ``fn`` to ln(sum exp z), max-shifted; maximum and sum are each
    evaluated once per row."""
    return once(F.array_max(z), lambda mx: once(
        mx + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))), fn))


def log_softmax(logits) -> Column:
    """Max-shifted log-softmax of one logit vector."""
    z = _col(logits)
    return _log_sum_exp(z, lambda lse: F.transform(z, lambda x: x - lse))


def gather_logp(logits, target) -> Column:
    """Log p of the target token (0-based id) under softmax(logits);
    NULL for a target outside the vocabulary, such as the mask -100."""
    z, t = _col(logits), _col(target)
    inside = (t >= 0) & (t < F.size(z))
    return F.when(inside, _log_sum_exp(z, lambda lse: F.element_at(z, t.cast("int") + 1) - lse))


def distribution_entropy(logits) -> Column:
    """-sum p ln(p + 1e-12) of softmax(logits)."""
    z = _col(logits)
    return _log_sum_exp(z, lambda lse: -F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - lse) * F.log(F.exp(x - lse) + F.lit(1e-12))))


def sequence_scores(logits, token_ids, n_prompt: Column | int = 0) -> Column:
    """M18/M19 over a sequence: ``logits`` has one vector per position (they
    score the next token), ``token_ids`` the tokens. Targets are shifted by
    one; those inside the prompt are masked. Returns struct(logp of the scored
    tokens in order, mean_entropy over their distributions, n_tokens)."""
    z, ids = _col(logits), _col(token_ids)
    start = F.greatest((n_prompt if isinstance(n_prompt, Column) else F.lit(n_prompt)), F.lit(1))
    n = F.least(F.size(ids), F.size(z) + 1)
    at = F.when(n > start, F.sequence(start, n - 1)).otherwise(F.array().cast("array<int>"))
    logp = F.transform(at, lambda i: gather_logp(F.element_at(z, i), F.element_at(ids, i + 1)))
    ent = F.transform(at, lambda i: distribution_entropy(F.element_at(z, i)))
    return F.struct(logp.alias("logp"), F.when(F.size(at) > 0, _sum(ent) / F.size(at)).alias("mean_entropy"), F.size(at).alias("n_tokens"))


def masked_cross_entropy(df: DataFrame, logp: str = "logp", label: str = "label",
                         keys=("step",)) -> DataFrame:
    """Mean of -log p over unmasked positions (label <> -100) per key,
    and its sum = mean * n."""
    keep = F.col(label) != -100
    return df.groupBy(*keys).agg(
        F.avg(F.when(keep, -F.col(logp))).alias("mean_loss"),
        F.sum(F.when(keep, -F.col(logp))).alias("sum_loss"),
        F.count(F.when(keep, 1)).alias("n_tokens"),
    )


def token_details(df: DataFrame, keys: Sequence[str], tokens: str, ids: str | None, logp: str) -> DataFrame:
    """One row per token: position, token, token_id, logprob, prob=exp(logprob).
    Stops at the shorter array; ``length_mismatch`` flags rows whose arrays differ (M24)."""
    arrays = [F.col(tokens).alias("token"), F.col(logp).alias("logprob")]
    if ids:
        arrays.insert(1, F.col(ids).alias("token_id"))
    sizes = [F.size(tokens), F.size(logp)] + ([F.size(ids)] if ids else [])
    z = df.select(*keys, F.arrays_zip(*arrays).alias("_z"), F.least(*sizes).alias("_m"),
                  (F.greatest(*sizes) != F.least(*sizes)).alias("length_mismatch"))
    e = z.select(*keys, "length_mismatch", "_m", F.posexplode("_z").alias("position", "_t"))
    cols = [*keys, "position", F.col("_t.token").alias("token")]
    if ids:
        cols.append(F.col("_t.token_id").alias("token_id"))
    cols += [F.col("_t.logprob").alias("logprob"), F.exp("_t.logprob").alias("prob"), "length_mismatch"]
    return e.filter(F.col("position") < F.col("_m")).select(*cols)


# --------------------------------------------------------------------------
# M25 / M26 expected pass@1 with n sampled answers (closed form)
# --------------------------------------------------------------------------

def expected_pass_with_n(pq: DataFrame, n_values: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """Expected share of questions with a correct answer among n
    answers drawn without replacement, and the std of that share over
    repetitions, per n (and group). Closed form: p_q = pass@min(n, size_q);
    mean = avg(p_q); std = sqrt(sum p_q (1 - p_q)) / Q. The n-list is a
    literal array exploded per row (no join)."""
    x = pq.withColumn("n_augmented", F.explode(F.array(*[F.lit(int(v)) for v in n_values])))
    x = x.withColumn("_p", pass_at_k_expr("n", "c", F.col("n_augmented")))
    return x.groupBy(*group, "n_augmented").agg(
        F.avg("_p").alias("expected_pass_at_1"),
        (F.sqrt(F.sum(F.col("_p") * (1 - F.col("_p")))) / F.count(F.lit(1))).alias("std_pass_at_1"),
        F.count(F.lit(1)).alias("n_questions"),
    )
