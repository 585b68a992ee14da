"""DuckDB-side (ANSI SQL) equivalents of the derived views, used by the
oracle queries. Each is a CTE body over the pre-registered driver tables."""

from __future__ import annotations

from ..functions import patterns as P
from .driver_tables import FILLER


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def grp(t: str, pattern: str, idx: int) -> str:
    return f"nullif(regexp_extract({t}, {q(pattern)}, {idx}), '')"


def dbl(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def shown_sql(question_id: str, digit: str) -> str:
    d = f"CAST({digit} AS VARCHAR)"
    return (f"CASE {question_id} % 6 WHEN 1 THEN '-' || {d} WHEN 2 THEN {d} || '.5' WHEN 3 THEN '1,00' || {d} "
            f"WHEN 4 THEN {d} || '.0' ELSE {d} END")


def number_sql(question_id: str, digit: str) -> str:
    d = f"CAST({digit} AS DOUBLE)"
    return f"CASE {question_id} % 6 WHEN 1 THEN -{d} WHEN 2 THEN {d} + 0.5 WHEN 3 THEN {d} + 1000 ELSE {d} END"


_DIGIT, _REF = "(floor(l_quantity)::BIGINT % 10)", "(floor(o_totalprice)::BIGINT % 10)"
_V = f"({shown_sql('l_orderkey', _DIGIT)})"
_D = "CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR)"
_FILL = q(FILLER)

COMPLETION = f"""CASE
  WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN concat('We add the parts. <answer>', {_V}, '</answer>')
  WHEN l_linenumber = 1 THEN concat('First we add, next we check. <answer> ', {_V}, ' </answer> Not ', {_D}, ' then.')
  WHEN l_linenumber = 2 AND l_orderkey % 2 = 0 THEN concat('Step 1: ', {_D}, ' items.' || chr(10) || '#### ', {_V})
  WHEN l_linenumber = 2 THEN concat('Step 1: <<', {_D}, '*2=', CAST(CAST(round(l_discount * 200) AS BIGINT) AS VARCHAR), '>> double. Step 2: stop.' || chr(10) || '#### ', {_V}, chr(10) || 'Checked.')
  WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN concat('So the total is found. The final answer is: ', {_V})
  WHEN l_linenumber = 3 THEN concat('Let''s think step by step. ', {_FILL}, {_FILL}, 'The final answer is ', {_V})
  WHEN l_linenumber = 4 AND l_orderkey % 2 = 0 THEN concat('Thus \\boxed{{', {_V}, '}}')
  WHEN l_linenumber = 4 THEN concat('Thus \\boxed {{', {_V}, '}} or \\(\\boxed{{', {_D}, '}}\\)')
  WHEN l_linenumber = 5 AND l_orderkey % 2 = 0 THEN concat('\\boxed{{\\frac{{', CAST({_DIGIT} * 2 AS VARCHAR), '}}{{2}}}}')
  WHEN l_linenumber = 5 THEN concat('\\boxed{{\\frac{{', CAST({_DIGIT} AS VARCHAR), '}}{{4}}}}')
  WHEN l_linenumber = 6 AND l_orderkey % 2 = 0 THEN concat('The answer is ', {_V}, '.')
  WHEN l_linenumber = 6 THEN concat('The answer is ', {_V}, ' apples, up ', {_D}, '%.')
  WHEN l_linenumber = 7 AND l_orderkey % 2 = 1 THEN concat({_FILL}, 'Another approach: count instead. Answer: ', {_D}, ' dollars' || chr(10) || 'Answer: ', {_V})
  ELSE concat('I could not finish after ', {_D}, ' steps.')
END"""

QUESTIONS = f"""questions AS (
  SELECT o_orderkey AS question_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
         {number_sql('o_orderkey', _REF)} AS expected_answer,
         concat('Order status ', o_orderstatus, '.' || chr(10) || '#### ', {shown_sql('o_orderkey', _REF)}) AS answer
  FROM orders)"""

RAW_SAMPLES = f"""raw_samples AS (
  SELECT l_orderkey AS question_id, l_linenumber AS sample_number, {COMPLETION} AS completion
  FROM lineitem)"""

SAMPLES = f"""{QUESTIONS},
{RAW_SAMPLES},
samples AS (
  SELECT r.question_id, r.sample_number, r.completion, q.level, q.expected_answer
  FROM raw_samples r JOIN questions q USING (question_id))"""


def six_way_sql(t: str, fraction: str = "value", missing_as_zero: bool = False, strip_commas: bool = True) -> str:
    if strip_commas:
        t = f"replace({t}, ',', '')"
    num, den = dbl(grp(t, P.SIX_WAY, 5)), dbl(grp(t, P.SIX_WAY, 6))
    frac = num if fraction == "numerator" else f"CASE WHEN {den} = 0 THEN NULL ELSE {num} / {den} END"
    parts = [dbl(grp(t, P.SIX_WAY, i)) for i in (1, 2, 3, 4)] + [frac, dbl(grp(t, P.SIX_WAY, 7))]
    out = "coalesce(" + ", ".join(parts) + ")"
    if missing_as_zero:
        out = f"coalesce({out}, 0.0)"
    return out


def relative_sql(p: str, e: str, rel: float = 0.01, floor: float = 1e-6) -> str:
    return f"coalesce(abs({p} - {e}) < greatest({floor}, abs({e}) * {rel}), false)"


GRADED = f"""{SAMPLES},
graded AS (
  SELECT *, {relative_sql('pred', 'expected_answer')} AS correct
  FROM (SELECT *, {six_way_sql('completion')} AS pred FROM samples))"""


def pass_at_k_sql(n: str, c: str, k) -> str:
    kk = f"least({k}, {n})"
    return (f"CASE WHEN {c} = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range({n} - {c} + 1, {n} + 1), "
            f"lambda i: 1 - {kk} / i)) END")


def first_pattern_sql(t: str, pats: list[str], strip_commas: bool = True) -> str:
    outs = []
    for p in pats:
        g = grp(t, p, 1)
        if strip_commas:
            g = f"replace({g}, ',', '')"
        outs.append(dbl(g))
    return "coalesce(" + ", ".join(outs) + ")"


def last_hit_sql(t: str, pats: list[str]) -> str:
    return "coalesce(" + ", ".join(dbl(f"regexp_extract_all({t}, {q(p)}, 1)[-1]") for p in pats) + ")"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def hybrid_sql(t: str) -> str:
    tt = strip_sql(f"replace({t}, ',', '')")
    tail = f"string_split({tt}, '.')[-1]"
    return (f"coalesce({dbl(grp(tt, P.HYBRID_BOXED, 1))}, {last_hit_sql(tt, P.HYBRID_LIST)}, "
            f"{dbl(f'regexp_extract_all({tail}, {q(P.HYBRID_TAIL)}, 1)[-1]')})")


def boxed_int_sql(t: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST({grp(t, p, 1)} AS BIGINT)" for p in P.BOXED_INT_LIST) + ")"


EMB_LOGP = "list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)))"
