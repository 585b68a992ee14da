"""End-to-end plans built from the operators: evaluate with k attempts (U11),
the level-by-level augmentation chain (U9), the feedback loop (U10, U13) and
the hard-question pipeline (U12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from ..functions import patterns as P
from ..functions import text as TX
from ..operators import aggregate as AG
from ..operators import inference as INF
from ..operators import metrics as M
from ..operators import shape as SH
from ..operators import training as TR
from ..session import ensure_checkpoint_dir
from ..streaming import checkpointed as CK


def evaluate(df: DataFrame, id_col: str, prompt_col: str, expected_col: str, k: int, solver_factory,
             levels=None, metadata=()) -> DataFrame:
    """Filter levels -> k completions -> six-way extraction -> relative
    grading -> per-question pass / counts (M2/M3); ``metadata`` columns (J12)
    are carried along.

    Exactly k attempts count per question: failed and missing replies are wrong attempts."""
    if levels is not None:
        df = df.filter(F.col("level").isin(list(levels)))
    carry = [c for c in metadata if c != id_col]
    gen = INF.generate(df, id_col, prompt_col, k, solver_factory, keep=[expected_col, *carry])
    g = gen.withColumn("pred", A.six_way("completion")).withColumn("correct", G.relative("pred", expected_col))
    return M.pass_any(g, keys=(id_col,), carry=tuple(carry))


#: Rows of a durable step of model calls.
STEP_ROWS = 10_000


def _called(df: DataFrame, key: str, work: CK.Work, path: str | None, stage: str, every_n: int) -> DataFrame:
    """``work`` (model calls) on ``df``, each made once: checkpointed, or with ``path`` in committed steps of a table of
    the stage, so that a new driver goes on where the last one stopped."""
    if path is None:
        return work(df).checkpoint(eager=True)
    return CK.write_in_steps(df, key, f"{path.rstrip('/')}/{stage}", every_n, "calls", work).drop("run_id", "step")


def augment_chain(spark: SparkSession, sources: DataFrame, id_col: str, text_col: str, levels: int,
                  samples: int, augmenter_factory, runner_factory, solver_factory,
                  novelty_samples: int = 8, min_novelty: float = 0.0, path: str | None = None,
                  every_n: int = STEP_ROWS) -> tuple[DataFrame, DataFrame]:
    """For each level, every surviving source gets ``samples`` candidates
    from its current best text; tags deduplicated (T5), blocks parsed (T1),
    the program checked (U5), novelty by failure of a solver (M12, run only
    for correct candidates), verdict (T24) and the best accepted candidate per
    source (G18) feeds the next level. A source with no accepted candidate
    stops. Model calls are checkpointed to the shared checkpoint folder right
    away, so each is made once per level, what was checked is what is kept, and
    a lost executor never replays calls of earlier levels. With ``path``, the
    candidates (by source) and the solver's answers (by candidate) of a level
    are durable tables written in steps of ``every_n`` rows: called again after
    its driver was lost, the chain finds by anti-joins what is there and sends
    only the other prompts. Returns (best per source and level, all candidates)."""
    ensure_checkpoint_dir(spark)
    cur = sources.select(F.col(id_col).alias("source_idx"), F.col(text_col).alias("current"))
    best_all, all_all = [], []
    for level in range(1, levels + 1):
        def candidates(rows: DataFrame, level: int = level) -> DataFrame:
            gen = INF.generate(rows, "source_idx", "current", samples, augmenter_factory)
            c = gen.withColumn("cand_no", F.col("sample_number")).withColumn("level", F.lit(level))
            blocks = TX.extract_blocks(TX.dedup_answer_tags(F.col("completion")))
            c = c.withColumn("b", blocks).select("source_idx", "level", "cand_no", "completion", "b.*")
            c = c.withColumn("cand_id", F.concat_ws(":", F.col("source_idx").cast("string"), F.lit(str(level)),
                                                    F.col("cand_no").cast("string")))
            return INF.check_program(c, "code", "solution", runner_factory)

        def solutions(rows: DataFrame) -> DataFrame:
            return INF.generate(rows, "cand_id", "prompt", novelty_samples, solver_factory, keep=["expected"])

        checked = _called(cur, "source_idx", candidates, path, f"level-{level}-candidates", every_n)
        ok = checked.filter("is_correct").select("cand_id", F.col("task").alias("prompt"), A.tag_or_hash("solution").alias("expected"))
        answers = _called(ok, "cand_id", solutions, path, f"level-{level}-answers", every_n)
        graded = answers.withColumn("correct", G.any_number("completion", "expected"))
        nov = M.novelty_by_failure(graded, novelty_samples, keys=("cand_id",))
        scored = checked.join(nov, "cand_id", "left")
        scored = scored.withColumn("reason", TX.candidate_reason("is_correct", "novelty", min_novelty=min_novelty))
        scored = scored.select("source_idx", "level", "cand_no", "code", "task", "solution", "novelty",
                               "is_correct", "reason").checkpoint(eager=True)
        accepted = scored.filter(F.col("reason") == "accepted")
        best = AG.best_per_group(accepted.withColumn("_s", F.struct(F.coalesce("novelty", F.lit(-1.0)),
                                                                   (-F.col("cand_no")).alias("c"))),
                                 ["source_idx", "level"], F.col("_s")).drop("_s").checkpoint(eager=True)
        all_all.append(scored)
        best_all.append(best)
        cur = best.select("source_idx", F.concat(F.lit("<task>"), F.col("task"), F.lit("</task>")).alias("current"))
    union = (lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:])))
    return union(best_all), union(all_all)


def feedback_loop(df: DataFrame, id_col: str, prompt_col: str, iterations: int, augmenter_factory, runner_factory,
                  solver_factory, novelty_samples: int = 4, path: str | None = None, every_n: int = STEP_ROWS) -> DataFrame:
    """A conversation per source. Each iteration sends the conversation
    (ChatML), appends the reply and then either what is wrong with it or its
    novelty score, and keeps every valid sample. Returns id, messages and
    samples (array of iteration, task, solution, code, final_answer, novelty).
    Model calls are checkpointed as they are made, or with ``path`` durable as in ``augment_chain``."""
    ensure_checkpoint_dir(df.sparkSession)
    turn = "array<struct<role:string,content:string>>"
    sample = "array<struct<iteration:int,task:string,solution:string,code:string,final_answer:bigint,novelty:double>>"
    cur = df.select(id_col, F.array(F.struct(F.lit("user").alias("role"), F.col(prompt_col).alias("content"))).cast(turn).alias("messages"),
                    F.array().cast(sample).alias("samples"))
    for i in range(1, iterations + 1):
        def replies(rows: DataFrame) -> DataFrame:
            ask = rows.withColumn("_p", TR.chatml("messages"))
            gen = INF.generate(ask, id_col, "_p", 1, augmenter_factory, keep=["messages", "samples"]).drop("sample_number", "attempts")
            got = gen.withColumn("b", TX.extract_blocks_greedy(F.coalesce("completion", F.lit("")))).select("*", "b.*").drop("b")
            return INF.check_program(got, "code", "solution", runner_factory)

        def solutions(rows: DataFrame) -> DataFrame:
            return INF.generate(rows, id_col, "_q", novelty_samples, solver_factory, keep=["_e"])

        got = _called(cur, id_col, replies, path, f"iteration-{i}-replies", every_n)
        valid = F.col("reason").isNull() & F.col("is_correct")
        ok = got.filter(valid).select(id_col, F.col("task").alias("_q"), F.col("final_answer").cast("double").alias("_e"))
        answers = _called(ok, id_col, solutions, path, f"iteration-{i}-answers", every_n)
        graded = answers.withColumn("correct", G.any_number("completion", "_e"))
        novelty = M.novelty_by_failure(graded, novelty_samples, keys=(id_col,))
        got = got.join(novelty, id_col, "left")
        missing = F.create_map(*[F.lit(x) for kv in P.FEEDBACK_MISSING.items() for x in kv])
        feedback = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("reason").isNotNull(), F.try_element_at(missing, "reason")) \
            .when(~F.col("is_correct"), F.lit(P.FEEDBACK_MISMATCH)) \
            .otherwise(F.replace(F.lit(P.FEEDBACK_NOVELTY), F.lit("{score}"), F.format_number(F.col("novelty") * 10, 1)))
        more = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("completion", F.lit("")).alias("content")),
                       F.struct(F.lit("user").alias("role"), feedback.alias("content"))).cast(turn)
        one = F.array(F.struct(F.lit(i).alias("iteration"), "task", "solution", "code", "final_answer", "novelty")).cast(sample)
        cur = got.select(id_col, F.concat("messages", more).alias("messages"),
                         F.when(valid, F.concat("samples", one)).otherwise(F.col("samples")).alias("samples")).checkpoint(eager=True)
    return cur


def flatten_samples(loop: DataFrame, id_col: str, runner_factory) -> DataFrame:
    """One row per kept sample of the feedback loop with a re-checked ``is_correct``."""
    rows = loop.select(id_col, F.explode("samples").alias("s")).select(id_col, "s.*")
    return INF.check_program(rows, "code", "solution", runner_factory).drop("run_error")


def hard_questions(df: DataFrame, id_col: str, question: str, answer: str, scorer_factory, augmenter_factory, verifier_factory,
                   augment_prompt: str, verify_prompt: str, min_perplexity: float) -> tuple[DataFrame, DataFrame]:
    """Questions whose answer is improbable (perplexity above the bar) are
    made harder (T8), judged (U7), and the accepted ones scored again. Returns
    (accepted with perplexity, rejected); each step's calls are checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    scored = INF.score_tokens(df, id_col, question, answer, scorer_factory, keep=[question, answer])
    hard = scored.withColumn("perplexity", M.perplexity("log_p")).filter(F.col("perplexity") > F.lit(min_perplexity)) \
        .select(id_col, F.col(question).alias("original_question"), F.col(answer).alias("original_answer"))
    ask = hard.withColumn("_p", TX.render_prompt(augment_prompt, question="original_question", answer="original_answer"))
    gen = INF.generate(ask, id_col, "_p", 1, augmenter_factory, keep=["original_question", "original_answer"])
    qa = TX.harder_question_answer("completion")
    pairs = gen.select(id_col, "original_question", "original_answer", qa["question"].alias("question"), qa["answer"].alias("answer")) \
        .checkpoint(eager=True)
    ask = pairs.withColumn("_p", TX.render_prompt(verify_prompt, question=F.coalesce("question", F.lit("")), answer=F.coalesce("answer", F.lit(""))))
    judged = INF.judge(ask, id_col, "_p", verifier_factory, keep=pairs.columns).drop("completion", "verdict").checkpoint(eager=True)
    _, accepted, rejected = SH.verdict_split(judged, F.col("verified") & F.col("question").isNotNull())
    again = INF.score_tokens(accepted, id_col, "question", "answer", scorer_factory, keep=accepted.columns)
    return again.withColumn("perplexity", M.perplexity("log_p")).drop("tokens", "log_p", "error"), rejected
