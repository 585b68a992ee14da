"""Text parsing, rewriting and feature functions (T1-T25) as Column expressions.

Failures that raise in the reference become NULL fields plus a flag or a
reason string, so one bad row never fails a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(t: Column, pattern: str, idx: int = 1) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, idx), F.lit(""))


def _matches(t: Column, pattern: str) -> Column:
    """Pattern found anywhere (RLIKE is a search, not a full match)."""
    return F.coalesce(t.rlike(pattern), F.lit(False))


def strip(c) -> Column:
    """Python str.strip(): remove leading/trailing whitespace (Spark trim only removes spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def strip_blank_newline(c) -> Column:
    """str.strip(' \\n')."""
    return F.regexp_replace(_col(c), r"^[ \n]+|[ \n]+$", "")


def _last_fence(t: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(t, F.lit(P.PYTHON_FENCE), F.lit(1)), F.lit(-1))


# --------------------------------------------------------------------------
# T1-T4 candidate blocks
# --------------------------------------------------------------------------

def extract_blocks(text) -> Column:
    """struct(code, task, solution, format_ok). Code from the code tag, else
    the last python fence; a missing block gives format_ok = false."""
    t = _col(text)
    tag_code = F.regexp_extract(t, P.CODE_BLOCK, 1)
    has_tag = _matches(t, P.CODE_BLOCK)
    code = F.when(has_tag, strip(tag_code)).otherwise(strip(_last_fence(t)))
    task = F.when(_matches(t, P.TASK_BLOCK), strip(F.regexp_extract(t, P.TASK_BLOCK, 1)))
    sol = F.when(_matches(t, P.SOLUTION_BLOCK), strip(F.regexp_extract(t, P.SOLUTION_BLOCK, 1)))
    ok = code.isNotNull() & task.isNotNull() & sol.isNotNull()
    return F.struct(code.alias("code"), task.alias("task"), sol.alias("solution"), ok.alias("format_ok"))


def code_block(text) -> Column:
    """The program of a reply: the code tag's content without its fence, else the last python fence."""
    t = _col(text)
    inner = F.regexp_extract(t, P.CODE_BLOCK, 1)
    return F.when(_matches(t, P.CODE_BLOCK), F.coalesce(strip(_last_fence(inner)), strip(inner))).otherwise(strip(_last_fence(t)))


def extract_blocks_lenient(text) -> Column:
    """Missing block -> ''; strips only blanks and newlines."""
    t = _col(text)
    has_tag = _matches(t, P.CODE_BLOCK_LENIENT)
    tag_code = strip(F.regexp_replace(F.regexp_extract(t, P.CODE_BLOCK_LENIENT, 1), r"^```python\s*", ""))
    code = F.when(has_tag, tag_code).otherwise(F.coalesce(strip(_last_fence(t)), F.lit("")))
    task = F.when(_matches(t, P.TASK_BLOCK_CS), strip_blank_newline(F.regexp_extract(t, P.TASK_BLOCK_CS, 1))) \
        .otherwise(F.lit(""))
    sol = F.when(_matches(t, P.SOLUTION_BLOCK_CS),
                 strip_blank_newline(F.regexp_extract(t, P.SOLUTION_BLOCK_CS, 1))).otherwise(F.lit(""))
    return F.struct(code.alias("code"), task.alias("task"), sol.alias("solution"))


def extract_blocks_greedy(text) -> Column:
    """Greedy blocks plus the final '#### n' answer as an integer;
    ``reason`` names the first missing part (NULL when all parts parsed)."""
    from .answers import hash_rest_int
    t = _col(text)
    inner = F.regexp_extract(t, P.GREEDY_CODE, 1)
    fences = F.regexp_extract_all(inner, F.lit(P.GREEDY_FENCE), F.lit(1))
    code = F.coalesce(strip(F.try_element_at(fences, F.lit(-1))), F.lit(""))
    task = F.regexp_extract(t, P.GREEDY_TASK, 1)
    sol = F.regexp_extract(t, P.GREEDY_SOLUTION, 1)
    final = hash_rest_int(sol)
    reason = (F.when(~_matches(t, P.GREEDY_CODE), F.lit("no_code"))
              .when(~_matches(t, P.GREEDY_TASK), F.lit("no_task"))
              .when(~_matches(t, P.GREEDY_SOLUTION), F.lit("no_solution"))
              .when(final.isNull(), F.lit("no_final_answer")))
    return F.struct(task.alias("task"), sol.alias("solution"), code.alias("code"),
                    final.alias("final_answer"), reason.alias("reason"))


def extract_json_reply(text, scratch_key: str = "scratchpad", public_key: str = "public") -> Column:
    """T4: JSON reply with a scratchpad and a public block, then T1 on the
    public block; bad JSON gives NULL fields and json_ok = false."""
    parsed = F.from_json(_col(text), f"`{scratch_key}` STRING, `{public_key}` STRING")
    pub = parsed[public_key]
    blocks = extract_blocks(pub)
    return F.struct(parsed[scratch_key].alias("scratchpad"), blocks.alias("blocks"),
                    (parsed.isNotNull() & pub.isNotNull()).alias("json_ok"))


def dedup_answer_tags(text) -> Column:
    """T5: inside each solution block (from its opening tag to the next closing
    tag) keep only the first complete answer tag. Blocks do not nest: after a
    closing tag the next opening tag starts a block, so an unclosed opening tag
    before a closed one belongs to that block's text."""
    t = _col(text)
    # A closing tag ends a piece; in each piece the block starts at the first opening tag.
    pieces = F.split(t, r"(?<=</solution>)")

    def fix(piece):
        start = F.locate("<solution>", piece)
        before = F.substring(piece, F.lit(1), start - 1)
        block = F.substring(piece, start, F.lit(1 << 30))
        # the first complete answer tag; a closing tag before it is ordinary text
        opening = F.locate("<answer>", block)
        rest = F.substring(block, opening, F.lit(1 << 30))
        end = opening + F.locate("</answer>", rest) + len("</answer>") - 2
        has = (opening > 0) & (F.locate("</answer>", rest) > 0)
        cleaned = F.concat(before, F.substring(block, F.lit(1), end), F.regexp_replace(F.substring(block, end + 1, F.lit(1 << 30)), P.ANSWER_TAG, ""))
        return F.when((start > 0) & piece.endswith("</solution>") & has, cleaned).otherwise(piece)

    return F.array_join(F.transform(pieces, fix), "")


def repair_code_tag(text) -> Column:
    """Wrap a bare python fence in a code tag when the tag is missing."""
    t = _col(text)
    fence = F.regexp_extract(t, r"(?s)(```python.*?```)", 1)
    return F.when((F.locate("<code>", t) == 0) & (fence != ""),
                  F.concat(F.lit("<code>\n"), fence, F.lit("\n</code>\n"), t)).otherwise(t)


def hash_to_boxed(text) -> Column:
    """Rewrite '#### n' as '\\boxed{n}', n being digits."""
    return F.regexp_replace(_col(text), P.HASH_DIGITS, r"\\boxed{$1}")


def harder_question_answer(text) -> Column:
    """struct(question, answer) from 'Harder Question: ... Harder Answer: ...'."""
    t = _col(text)
    return F.struct(strip(_group(t, P.HARDER_QUESTION)).alias("question"),
                    strip(_group(t, P.HARDER_ANSWER)).alias("answer"))


def verification_passed(text) -> Column:
    """T9: 'Verification Result: True' present."""
    return F.coalesce(_col(text).contains(P.VERIFICATION_TRUE), F.lit(False))


def math_solution(text) -> Column:
    """Text after 'Math Solution:' to the end of the line."""
    return strip(_group(_col(text), P.MATH_SOLUTION))


def judge_verdict(text) -> Column:
    """T11: 'A' / 'B' from a [[A]] / [[B]] marker, NULL if absent."""
    return _group(_col(text), r"\[\[([AB])\]\]")


def judge_prompt(question, answer_a, answer_b, template: str = P.JUDGE_TEMPLATE) -> Column:
    """The pairwise judge's prompt, by literal replacement."""
    return render_prompt(template, question=question, answer_a=answer_a, answer_b=answer_b)


def strip_prompt(completion, prompt) -> Column:
    """Drop the prompt when the completion starts with it, then strip."""
    c, p = _col(completion), _col(prompt)
    return strip(F.when(c.startswith(p), F.substring(c, F.length(p) + 1, F.lit(1 << 30))).otherwise(c))


def after_last_assistant(completion) -> Column:
    """T12 (ChatML form): text after the last assistant marker, stripped."""
    return strip(F.substring_index(_col(completion), P.ASSISTANT_TAG, -1))


def render_prompt(template: str, **fields) -> Column:
    """Fill ``{name}`` placeholders with columns; literal replacement, so
    '%' and braces inside field values are safe."""
    out = F.lit(template)
    for name, col in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_col(col).cast("string"), F.lit("")))
    return out


def training_text(question, answer) -> Column:
    """Question, answer and the sliced final answer on separate lines."""
    from .answers import after_last_hashes
    q, a = _col(question), _col(answer)
    return F.concat_ws("\n", strip(q), strip(a), F.concat(F.lit("Answer: "), after_last_hashes(a)))


#: What ``str.split()`` takes as blank.
BLANK_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def word_count(text) -> Column:
    """len(text.split()), Unicode blanks included. They become spaces first: a split at spaces takes a tenth of the
    time of a regular expression with their class."""
    t = _col(text)
    spaced = F.translate(t, BLANK_CHARS, " " * len(BLANK_CHARS))
    return F.when(t.isNotNull(), F.size(F.split(F.rtrim(F.concat(F.lit("x "), spaced)), " +")) - 1)


def operator_count(text) -> Column:
    """Number of + - * / characters."""
    t = _col(text)
    return F.length(t) - F.length(F.translate(t, "+-*/", ""))


def char_length(text) -> Column:
    """Length in characters."""
    return F.length(_col(text))


def newline_count(text) -> Column:
    t = _col(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def step_count_v1(text) -> Column:
    """Sum of hits of each step word (lower-cased), else newlines + 1."""
    from .answers import once

    def hits(t):
        out = None
        for p in P.STEP_WORDS:
            h = F.regexp_count(t, F.lit(p))
            out = h if out is None else out + h
        return out
    return once(once(F.lower(_col(text)), hits), lambda h: F.when(h > 0, h).otherwise(newline_count(text) + 1))


def step_count_v2(text) -> Column:
    """Hits of the single alternation, else newlines + 1."""
    from .answers import once
    hits = F.regexp_count(F.lower(_col(text)), F.lit(P.STEP_ALTERNATION))
    return once(hits, lambda h: F.when(h > 0, h).otherwise(newline_count(text) + 1))


def mean_steps(answers, version: int = 1) -> Column:
    """Mean step count over a list of answers; NULL entries skipped;
    empty list -> 0 (v1) or NULL (v2)."""
    fn = step_count_v1 if version == 1 else step_count_v2
    a = F.filter(_col(answers), lambda x: x.isNotNull())
    steps = F.transform(a, lambda x: fn(x))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    mean = F.when(F.size(steps) > 0, total / F.size(steps))
    return F.coalesce(mean, F.lit(0.0)) if version == 1 else mean


def annotated_calc_count(text) -> Column:
    """Number of '<<a=b>>' annotated calculations."""
    return F.regexp_count(_col(text), F.lit(P.ANNOTATED_CALC))


def error_category_v1(prediction) -> Column:
    """No Answer / Calculation Error / Incomplete Answer / Wrong Approach / Other Error."""
    p = _col(prediction)
    lo = F.lower(p)
    return (F.when(p.isNull(), F.lit(P.ERROR_NONE))
            .when(lo.contains(P.THINK_PHRASE) & (F.length(p) > P.LONG_REASONING) & _matches(lo, P.FINAL_PHRASE),
                  F.lit(P.ERROR_CALCULATION))
            .when(F.length(p) < P.SHORT_ANSWER, F.lit(P.ERROR_INCOMPLETE))
            .when(lo.contains("approach") & lo.contains("instead"), F.lit(P.ERROR_APPROACH))
            .otherwise(F.lit(P.ERROR_OTHER)))


def error_category_v2(prediction) -> Column:
    """No answer / Incomplete (< 150 chars) / Calc error / Other."""
    p = _col(prediction)
    return (F.when(p.isNull(), F.lit(P.ERROR2_NONE))
            .when(F.length(p) < P.SHORT_ANSWER, F.lit(P.ERROR2_INCOMPLETE))
            .when(_matches(p, P.ANSWER_IS_WORD), F.lit(P.ERROR2_CALCULATION))
            .otherwise(F.lit(P.ERROR2_OTHER)))


def candidate_reason(is_correct, novelty, difficulty=None, min_novelty: float = 0.0,
                     min_difficulty: float = 0.0, step_count=None, step_target: int | None = None) -> Column:
    """too_few_steps (optional) -> incorrect_code -> too_low_novelty ->
    too_low_difficulty (optional) -> accepted. ``abs(x) < threshold`` as in
    the reference, so a threshold of 0 never rejects (Q8)."""
    out = F.when(~F.coalesce(_col(is_correct), F.lit(False)), F.lit(P.REASON_INCORRECT)) \
        .when(F.abs(_col(novelty)) < F.lit(min_novelty), F.lit(P.REASON_LOW_NOVELTY))
    if difficulty is not None:
        out = out.when(F.abs(_col(difficulty)) < F.lit(min_difficulty), F.lit(P.REASON_LOW_DIFFICULTY))
    out = out.otherwise(F.lit(P.REASON_ACCEPTED))
    if step_count is not None and step_target is not None:
        out = F.when(_col(step_count) < F.lit(step_target + 1), F.lit(P.REASON_FEW_STEPS)).otherwise(out)
    return out


def messages(system_prompt: str, user, assistant) -> Column:
    """array<struct<role, content>> of a system, user and assistant turn."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), strip(user).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _col(assistant).alias("content")),
    )
