"""Grading predicates (M5-M10) as Column expressions.

A grade is a boolean Column. Unless a function says otherwise a NULL
prediction or NULL reference grades as ``False`` (never NULL), so counting
correct samples with ``sum(cast(correct as int))`` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import all_numbers


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def relative(pred, expected, rel: float = 0.01, floor: float = 1e-6) -> Column:
    """M5: |pred - exp| < max(floor, rel * |exp|)."""
    p, e = _col(pred), _col(expected)
    tol = F.greatest(F.lit(floor), F.abs(e) * F.lit(rel))
    return F.coalesce(F.abs(p - e) < tol, F.lit(False))


def absolute(pred, expected, tol: float = 1e-6) -> Column:
    """M6 (tol 1e-6) / M7 (tol 1e-2): |pred - exp| < tol; NULL on either side is wrong."""
    p, e = _col(pred), _col(expected)
    return F.coalesce(F.abs(p - e) < F.lit(tol), F.lit(False))


def absolute_text_reference(pred, expected_text, tol: float = 1e-2) -> Column:
    """M7: the reference is text; an unparsable reference grades as wrong."""
    from .answers import to_double
    return absolute(pred, to_double(_col(expected_text)), tol)


def exact(pred, expected, null_equal: bool = False) -> Column:
    """M8: equality; ``null_equal=True`` makes NULL = NULL correct (quirk Q5)."""
    p, e = _col(pred), _col(expected)
    if null_equal:
        return p.eqNullSafe(e)
    return F.coalesce(p == e, F.lit(False))


def rounded(pred, expected, digits: int = 3) -> Column:
    """M9: equal after rounding to ``digits`` decimals (Spark rounds half up)."""
    p, e = _col(pred), _col(expected)
    return F.coalesce(F.round(p, digits) == F.round(e, digits), F.lit(False))


def any_number(text, expected, rel: float = 0.01, floor: float = 1e-6) -> Column:
    """Correct if any number in the text matches under M5."""
    e = _col(expected)
    tol = F.greatest(F.lit(floor), F.abs(e) * F.lit(rel))
    return F.coalesce(F.exists(all_numbers(text), lambda x: F.abs(x - e) < tol), F.lit(False))
