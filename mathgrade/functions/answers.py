"""Numeric-answer extraction (A1-A16) as native Column expressions.

Three combinators cover the reference's rules:

* ``earliest``  - one alternation, the leftmost match in the text wins (A1-A3, A8);
* ``first_pattern`` - patterns tried in order, the first that parses wins (A4, A6);
* ``last_hit`` - for each pattern in order, the last match of it wins (A5).

Every function takes and returns Columns built from JVM expressions; nothing
here calls Python per row. A long text is scanned once per pattern: values
reused several times are bound once with ``once`` (a one-element
``transform``), and six-way / tag-or-hash read their groups from the short
leftmost match instead of re-scanning the text for every group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

NUMERIC_RX = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(text: Column, pattern: str, idx: int) -> Column:
    """Group ``idx`` of the first match, NULL when absent (not '')."""
    return F.nullif(F.regexp_extract(text, pattern, idx), F.lit(""))


def once(expr: Column, fn) -> Column:
    """Evaluate ``expr`` a single time and apply ``fn`` to it: the value is
    bound to a lambda variable, so references inside ``fn`` never re-run the
    (regex) expression, whatever common-subexpression elimination does."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def to_double(s: Column) -> Column:
    """Parse a number the way Python's float() does on regex output:
    validate first (Spark would accept '5d' or 'NaN'), then cast."""
    return once(s, lambda x: F.when(x.rlike(NUMERIC_RX), x.try_cast("double")))


def _strip_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def earliest(text, pattern: str, groups: list[int]) -> Column:
    """First non-empty group of the leftmost match of one alternation."""
    t = _col(text)
    return F.coalesce(*[_group(t, pattern, g) for g in groups])


def first_pattern(text, pattern_list: list[str], parse=to_double, strip_commas=True) -> Column:
    """Try patterns in order; the first whose match parses wins."""
    t = _col(text)
    outs = []
    for p in pattern_list:
        g = _group(t, p, 1)
        if strip_commas:
            g = _strip_commas(g)
        outs.append(parse(g))
    return F.coalesce(*outs)


def last_hit(text, pattern_list: list[str]) -> Column:
    """For each pattern in order, the last of its matches; first pattern with a hit wins."""
    t = _col(text)
    return F.coalesce(*[to_double(F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1)))
                        for p in pattern_list])


# --------------------------------------------------------------------------
# Profiles
# --------------------------------------------------------------------------

def _on_leftmost_match(t: Column, pattern: str, fn) -> Column:
    """Scan the (long) text once for the leftmost match of an alternation,
    then read groups from the short matched string only. The alternatives of
    the patterns used here begin with distinct literals, so re-matching the
    matched string selects the same alternative and groups."""
    return once(F.regexp_extract(t, pattern, 0), fn)


def tag_or_hash(text, strip_commas: bool = True) -> Column:
    """A1: number in an answer tag, else after four hashes; earliest match.
    NULL when absent (the reference raises)."""
    t = _col(text)
    if strip_commas:
        t = _strip_commas(t)
    return _on_leftmost_match(t, P.TAG_OR_HASH, lambda m: to_double(earliest(m, P.TAG_OR_HASH, [1, 2])))


def six_way(text, fraction: str = "value", missing_as_zero: bool = False,
            strip_commas: bool = True) -> Column:
    """A2/A3: tag, hashes, final-answer phrase, boxed number, boxed fraction,
    answer phrase; the earliest match in the text wins.

    ``fraction='numerator'`` and ``missing_as_zero=True`` and
    ``strip_commas=False`` reproduce the reference exactly (quirks Q1, Q2, Q18).
    """
    t = _col(text)
    if strip_commas:
        t = _strip_commas(t)

    def from_match(m):
        num, den = _group(m, P.SIX_WAY, 5), _group(m, P.SIX_WAY, 6)
        if fraction == "numerator":
            frac = to_double(num)
        else:
            frac = F.try_divide(to_double(num), to_double(den))
        return F.coalesce(
            to_double(_group(m, P.SIX_WAY, 1)),
            to_double(_group(m, P.SIX_WAY, 2)),
            to_double(_group(m, P.SIX_WAY, 3)),
            to_double(_group(m, P.SIX_WAY, 4)),
            frac,
            to_double(_group(m, P.SIX_WAY, 7)),
        )

    val = _on_leftmost_match(t, P.SIX_WAY, from_match)
    if missing_as_zero:
        val = F.coalesce(val, F.lit(0.0))
    return val


def ordered_list(text) -> Column:
    """A4: eight patterns in order; the last takes the first number anywhere."""
    return first_pattern(text, P.ORDERED_LIST)


def hybrid(text) -> Column:
    """A5: strip commas; boxed; else last hit of six patterns; else the last
    number in the text after the final '.'."""
    def from_clean(t):
        tail = F.substring_index(t, ".", -1)
        return F.coalesce(
            to_double(_group(t, P.HYBRID_BOXED, 1)),
            last_hit(t, P.HYBRID_LIST),
            to_double(F.try_element_at(F.regexp_extract_all(tail, F.lit(P.HYBRID_TAIL), F.lit(1)), F.lit(-1))),
        )
    return once(F.regexp_replace(_strip_commas(_col(text)), r"^\s+|\s+$", ""), from_clean)


def boxed_int(text) -> Column:
    """Boxed integer patterns in order, integer result, NULL if none.
    The fourth pattern has no group; its match can never be an integer (Q6)."""
    t = _col(text)
    outs = [F.when(_group(t, p, 1).rlike(r"^\d+$"), _group(t, p, 1).try_cast("bigint"))
            for p in P.BOXED_INT_LIST]
    return F.coalesce(*outs)


def hash_number(text) -> Column:
    """Characters 0-9 . , - after four hashes, commas dropped; NULL if unparsable."""
    return to_double(_strip_commas(_group(_col(text), P.HASH_NUMBER, 1)))


def hash_phrase_boxed(text) -> Column:
    """Hashes, 'The answer is', or boxed (with a blank before the brace)."""
    return to_double(_strip_commas(_group(_col(text), P.HASH_PHRASE_BOXED, 1)))


def hash_text(text) -> Column:
    """As A7 but the string without commas."""
    return F.nullif(_strip_commas(_group(_col(text), P.HASH_NUMBER, 1)), F.lit(""))


def hash_digits(text, pattern_list: list[str] | None = None) -> Column:
    """A10: digits after hashes as a string; list of patterns, first hit."""
    t = _col(text)
    return F.coalesce(*[_group(t, p, 1) for p in (pattern_list or [P.HASH_DIGITS])])


def last_line_number(text, as_float_text: bool = True) -> Column:
    """Last numeric token of the last line (commas stripped); '' if none.
    ``as_float_text`` renders the number as Python prints a float (FT1)."""
    t = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    last_line = F.element_at(F.split(t, "\n"), -1)
    toks = F.split(F.regexp_replace(_strip_commas(last_line), r"^\s+|\s+$", ""), r"\s+")
    good = F.filter(toks, lambda x: x.rlike(r"^(\d+\.?\d*|\.\d+)$"))
    tok = F.try_element_at(good, F.lit(-1))
    if as_float_text:
        tok = once(tok.try_cast("double"), float_text)
    return F.coalesce(tok, F.lit(""))


def float_text(x: Column) -> Column:
    """A non-negative double as Python prints it: positional with at least one decimal from 1e-4 to below 1e16
    (the engine already switches to exponents at 1e7 and 1e-3), else a two-digit exponent."""
    shown = x.cast("string")
    mantissa, exponent = F.substring_index(shown, "E", 1), F.substring_index(shown, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    large = F.concat(F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.lit("."),
                     F.when(F.length(digits) > exponent + 1, F.substring(digits, exponent + 2, F.lit(400))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    sign = F.when(exponent < 0, "-").otherwise("+")
    power = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.lit(400)))).otherwise(""),
                     F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.when(~shown.contains("E"), shown).when((x >= 1e7) & (x < 1e16), large).when((x >= 1e-4) & (x < 1e-3), small).otherwise(power)


def hash_rest_int(text) -> Column:
    """The rest of the line after '#### ' as an integer."""
    g = F.regexp_replace(_group(_col(text), P.HASH_REST_OF_LINE, 1), r"^\s+|\s+$", "")
    return F.when(g.rlike(r"^[+-]?\d+$"), g.try_cast("bigint"))


def all_numbers(text) -> Column:
    """Every number in the text (sign, decimals, exponent), in text order."""
    arr = F.regexp_extract_all(_col(text), F.lit(P.NUM_ANY), F.lit(0))
    return F.transform(arr, lambda x: x.try_cast("double"))


def after_last_hashes(text) -> Column:
    """Text after the last '####', stripped."""
    return F.regexp_replace(F.substring_index(_col(text), "####", -1), r"^\s+|\s+$", "")


def program_number(text, signed: bool = True) -> Column:
    """First number in program output; the reference drops the sign (Q11)."""
    p = P.PROGRAM_NUMBER_SIGNED if signed else P.PROGRAM_NUMBER_UNSIGNED
    return to_double(_group(_col(text), p, 1))


def after_last_answer_marker(text) -> Column:
    """Text after the last 'Answer:', stripped; whole text if absent."""
    return F.regexp_replace(F.substring_index(_col(text), "Answer:", -1), r"^\s+|\s+$", "")


PROFILES = {
    "tag_or_hash": tag_or_hash,
    "six_way": six_way,
    "six_way_numerator": lambda t: six_way(t, fraction="numerator"),
    "ordered_list": ordered_list,
    "hybrid": hybrid,
    "boxed_int": boxed_int,
    "hash_number": hash_number,
    "hash_phrase_boxed": hash_phrase_boxed,
}


def extract_answer(text, profile: str = "six_way") -> Column:
    """Dispatch to one extraction profile by name."""
    if profile not in PROFILES:
        raise ValueError(f"unknown extraction profile {profile!r}; choose from {sorted(PROFILES)}")
    return PROFILES[profile](text)
