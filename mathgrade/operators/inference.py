"""Batch inference with caller-supplied model functions.

Model calls are the only per-row Python in the library. They run inside
``mapInPandas``: the caller's client is built once per partition by a factory,
rows arrive in Arrow batches, and per-row failures become an ``error``
column instead of failing the task. Outputs are keyed (row id, sample
number), so a task retried after a lost executor rewrites the same keys.
"""

from __future__ import annotations

import hashlib
import multiprocessing
import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as A
from ..functions import grading as G
from ..functions import text as TX
from ..session import all_tasks, ensure_checkpoint_dir
from . import aggregate as AG

# A model function takes a list of prompts and n, and returns n completions per prompt.
GenerateFn = Callable[[list[str], int], list[list[str]]]


def _retry(call, max_tries: int, backoff_base: float, seed: str, before: int = 0):
    """Attempts number ``before + 1`` to ``max_tries``, waiting base * 2^(i-1) * U(0.8, 1.2) between them;
    returns (value, error, attempts so far). Jitter is seeded per row."""
    rng = random.Random(seed)
    err, attempt = None, before
    for attempt in range(before + 1, max_tries + 1):
        try:
            return call(), None, attempt
        except Exception as ex:  # noqa: BLE001 - a row-level failure is data
            err = f"{type(ex).__name__}: {ex}"
            if attempt < max_tries and backoff_base > 0:
                time.sleep(backoff_base * 2 ** (attempt - 1) * rng.uniform(0.8, 1.2))
    return None, err, attempt


def in_order(calls: Iterable[Callable[[], object]], in_flight: int) -> Iterator[object]:
    """Results of ``calls`` in their order, with at most ``in_flight`` of them running.

    A call is taken from the input only when a place is free, so neither waiting inputs nor finished results pile up."""
    if in_flight <= 1:
        for call in calls:
            yield call()
        return
    with ThreadPoolExecutor(in_flight) as pool:
        running: deque = deque()
        for call in calls:
            if len(running) == in_flight:
                yield running.popleft().result()
            running.append(pool.submit(call))
        while running:
            yield running.popleft().result()


#: Replies of short calls are put together to batches of about so many rows or characters.
OUT_ROWS, OUT_CHARS = 4096, 1 << 22
MISSING_COMPLETION = "missing completion"
MISSING_PROMPT = "missing prompt"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by their key, for calls that cost more than reading the row: a scan gives a small file
    with many short prompts to one task."""
    return df.repartition(all_tasks(df.sparkSession), key)


def generate(df: DataFrame, id_col: str, prompt_col: str, n: int, fn_factory: Callable[[], GenerateFn],
             max_tries: int = 3, backoff_base: float = 0.0, batch_size: int = 32, keep: Sequence[str] = (),
             in_flight: int = 1) -> DataFrame:
    """Exactly n rows per input row: (id, kept columns, sample_number, completion, error, attempts).

    A batch of prompts is one call and the first attempt of its rows; if it fails, each row is tried alone for the
    attempts that are left, so one bad prompt only fails itself and no prompt is sent more than ``max_tries``
    times. Replies that are missing or failed are rows with an error. A null prompt is not sent. ``keep`` columns
    travel with the row (no join back, so the model is not asked again for them). ``in_flight`` calls of a task run at
    once (threads, for clients that wait on a network); the client must allow that. Retries wait in their own thread.
    Rows come out in their order."""
    carried = [id_col, *[c for c in keep if c != id_col]]
    schema = T.StructType([*[df.schema[c] for c in carried], T.StructField("sample_number", T.IntegerType()),
                           T.StructField("completion", T.StringType()), T.StructField("error", T.StringType()),
                           T.StructField("attempts", T.IntegerType())])

    def replies(one, err, tries):
        got = [None if c is None else str(c) for c in list(one or [])[:n]]
        got += [None] * (n - len(got))
        return [(j, c, None if c is not None else err or MISSING_COMPLETION, tries) for j, c in enumerate(got)]

    def ask(fn: GenerateFn, ids: list, prompts: list, start: int) -> list[tuple]:
        rows = range(len(ids))
        sent = [i for i in rows if prompts[i] is not None]
        seed = hashlib.md5(repr(ids).encode()).hexdigest()
        outs, err, tries = _retry(lambda: fn([prompts[i] for i in sent], n), 1, 0.0, seed) if sent else ([], None, 0)
        found = {i: replies(None, MISSING_PROMPT, 0) for i in rows if prompts[i] is None}
        if outs is not None:
            outs = list(outs) + [[]] * (len(sent) - len(outs))
            found |= {i: replies(o, None, tries) for i, o in zip(sent, outs, strict=False)}
        else:
            for i in sent:
                one, e1, t1 = _retry(lambda i=i: fn([prompts[i]], n)[0], max_tries, backoff_base, f"{seed}{ids[i]}", before=1)
                found[i] = replies(one, e1 or (err if max_tries == 1 else None), t1)
        return [(start + i, *r) for i in rows for r in found[i]]

    def calls(fn: GenerateFn, batches: Iterator[pa.RecordBatch]) -> Iterator[Callable[[], tuple]]:
        for batch in batches:
            ids, prompts = batch.column(id_col).to_pylist(), batch.column("_prompt").to_pylist()
            for start in range(0, batch.num_rows, batch_size):
                piece = slice(start, start + batch_size)
                yield lambda batch=batch, a=ids[piece], b=prompts[piece], start=start: (batch, ask(fn, a, b, start))

    def written(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        at, *values = zip(*out, strict=True)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(at, pa.int64())) for c in carried], *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]],
            [*carried, "sample_number", "completion", "error", "attempts"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, chars = None, [], 0
        for batch, rows in in_order(calls(fn_factory(), batches), in_flight):
            if out and (batch is not held or len(out) >= OUT_ROWS or chars >= OUT_CHARS):
                yield written(held, out)
                out, chars = [], 0
            held = batch
            out += rows
            chars += sum(len(r[2] or "") for r in rows)
        if out:
            yield written(held, out)

    return df.select(*carried, F.col(prompt_col).cast("string").alias("_prompt")).mapInArrow(part, schema)


def score_tokens(df: DataFrame, id_col: str, prompt_col: str, answer_col: str,
                 fn_factory: Callable[[], Callable[[str, str], tuple[list[str], list[float]]]], keep: Sequence[str] = ()) -> DataFrame:
    """Tokens and per-token log-probs of the answer given the prompt from a
    caller's scorer; metrics (M16, M19, ...) are then native array functions.
    ``keep`` columns travel along; a failing row has an error."""
    carried = [id_col, *[c for c in keep if c != id_col]]
    schema = T.StructType([*[df.schema[c] for c in carried], T.StructField("tokens", T.ArrayType(T.StringType())),
                           T.StructField("log_p", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = fn_factory()
        for batch in batches:
            tokens, scores, errors = [], [], []
            for p, a in zip(batch.column("_prompt").to_pylist(), batch.column("_answer").to_pylist(), strict=True):
                try:
                    toks, lps = fn(p or "", a or "")
                    tokens.append([str(t) for t in toks])
                    scores.append([float(x) for x in lps])
                    errors.append(None)
                except Exception as ex:  # noqa: BLE001 - a row-level failure is data
                    tokens.append(None)
                    scores.append(None)
                    errors.append(f"{type(ex).__name__}: {ex}")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(tokens, pa.list_(pa.string())),
                                              pa.array(scores, pa.list_(pa.float64())), pa.array(errors, pa.string())], [*carried, "tokens", "log_p", "error"])

    return df.select(*carried, F.col(prompt_col).cast("string").alias("_prompt"), F.col(answer_col).cast("string").alias("_answer")) \
        .mapInArrow(part, schema)


class Watched:
    """A runner in a process of its own that is killed when a program takes longer than the limit.

    The process is forked from the task, builds its runner once and serves one program after the other; after a kill,
    or if a program ends the process, the next program gets a new one."""

    def __init__(self, runner_factory: Callable[[], Callable[[str, float], str]], timeout: float):
        self.factory, self.timeout, self.process = runner_factory, timeout, None

    def _serve(self, pipe) -> None:
        run = self.factory()
        while True:
            try:
                code = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send((str(run(code, self.timeout)), None))
            except Exception as ex:  # noqa: BLE001 - a row-level failure is data
                pipe.send((None, f"{type(ex).__name__}: {ex}"))

    def __call__(self, code: str) -> tuple[str | None, str | None]:
        """(output, error)"""
        if self.process is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.process = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self.process.start()
            theirs.close()
        self.pipe.send(code)
        try:
            if self.pipe.poll(self.timeout):
                return self.pipe.recv()
            error = f"TimeoutError: no output after {self.timeout:g} s"
        except (EOFError, OSError):
            error = "RuntimeError: the program ended its process"
        self.close()
        return None, error

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def run_programs(df: DataFrame, code_col: str, runner_factory: Callable[[], Callable[[str, float], str]],
                 timeout: float = 5.0) -> DataFrame:
    """U5 (execution part): the caller's runner executes each program in a
    watched process, which is killed after ``timeout`` seconds (Q13), and
    returns its output; failures -> NULL output and an error. All columns
    travel with the row; rows without code are not run."""
    schema = T.StructType([*df.schema.fields, T.StructField("program_output", T.StringType()), T.StructField("run_error", T.StringType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Watched(runner_factory, timeout)
        try:
            for batch in batches:
                done = [run(code) if code else (None, None) for code in batch.column(code_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o for o, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())],
                                                 [*batch.schema.names, "program_output", "run_error"])
        finally:
            run.close()

    return df.mapInArrow(part, schema)


def grade_output(df: DataFrame, output_col: str, solution_col: str, signed: bool = True) -> DataFrame:
    """U5 on captured outputs (a column, e.g. of a joined table): the first
    number of the output (A15) against the solution's tagged answer (A1),
    rounded to 3 places (M9)."""
    value = A.program_number(F.col(output_col), signed=signed)
    expected = A.tag_or_hash(F.col(solution_col))
    return df.withColumn("is_correct", G.rounded(value, expected, 3))


def check_program(df: DataFrame, code_col: str, solution_col: str, runner_factory, timeout: float = 5.0,
                  signed: bool = True) -> DataFrame:
    """Run the program of each row that has one, then grade its output."""
    return grade_output(run_programs(df, code_col, runner_factory, timeout), "program_output", solution_col, signed)


def rerank(df: DataFrame, keys: Sequence[str], text_col: str, reward_factory) -> DataFrame:
    """U8: reward per candidate (Arrow-batched iterator UDF, model built once
    per task), then the ranked list and best per prompt (G19)."""

    @F.pandas_udf(T.DoubleType())
    def reward(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = reward_factory()
        for s in it:
            yield pd.Series([float(fn(x)) if x is not None else None for x in s])

    scored = df.withColumn("reward", reward(F.col(text_col)))
    return AG.ranked_list(scored, list(keys), "reward", text_col)


def judge(df: DataFrame, id_col: str, prompt_col: str, fn_factory, keep: Sequence[str] = ()) -> DataFrame:
    """One verifier reply per row, then the verdict flag (T9) and the
    [[A]]/[[B]] marker (T11). ``keep`` columns stay, so the verified and
    rejected views (J9) are filters on the result."""
    g = generate(df, id_col, prompt_col, 1, fn_factory, keep=keep)
    return g.select(id_col, *[c for c in keep if c != id_col], "completion", TX.verification_passed("completion").alias("verified"),
                    TX.judge_verdict("completion").alias("verdict"))


def repair_format(df: DataFrame, id_col: str, text_col: str, repair_prompt: Callable[[Column], Column],
                  fn_factory, rounds: int = 3) -> DataFrame:
    """U4: up to ``rounds`` checks; rows whose blocks do not parse are sent
    back with a repair prompt, the rest pass through. A failed call keeps the
    text as it was. Each round is checkpointed, so no call is made twice."""
    ensure_checkpoint_dir(df.sparkSession)
    ok = TX.extract_blocks(text_col)["format_ok"]
    cur = df.withColumn("format_ok", ok)
    for _ in range(rounds - 1):
        todo = cur.filter(~F.col("format_ok")).withColumn("_p", repair_prompt(F.col(text_col)))
        fixed = generate(todo, id_col, "_p", 1, fn_factory, keep=df.columns)
        fixed = fixed.withColumn(text_col, F.coalesce("completion", text_col)).select(*df.columns).withColumn("format_ok", ok)
        cur = cur.filter("format_ok").unionByName(fixed).checkpoint(eager=True)
    return cur


def text_to_program(df: DataFrame, id_col: str, prompt_col: str, solution_col: str, fn_factory, runner_factory,
                    attempts: int = 3) -> DataFrame:
    """Ask for a program up to ``attempts`` times, until one's output
    equals the solution's answer. One row per input row: its columns, code (of
    the first program that agrees, else of the last attempt), program_output,
    is_correct and attempts. Each attempt asks only rows not solved yet and is
    checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    names = ["code", "program_output", "is_correct", "attempts"]
    todo, done = df, None
    for attempt in range(1, attempts + 1):
        gen = generate(todo, id_col, prompt_col, 1, fn_factory, keep=df.columns).drop("attempts")
        gen = gen.withColumn("code", TX.code_block("completion"))
        out = check_program(gen, "code", solution_col, runner_factory).withColumn("attempts", F.lit(attempt)) \
            .select(*df.columns, *names).checkpoint(eager=True)
        ready = out if attempt == attempts else out.filter("is_correct")
        done = ready if done is None else done.unionByName(ready)
        todo = out.filter("not is_correct").select(*df.columns)
    return done
