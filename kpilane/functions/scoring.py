"""Scoring expressions: percent to target, weighted totals, RAG bands, clamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpilane.schemas import AMBER_AT, GREEN_AT


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """``n / d`` that is NULL when ``d`` is zero or NULL (never raises under ANSI)."""
    return F.try_divide(_c(numerator), _c(denominator))


def pct_to_target(actual: Column | str, target: Column | str) -> Column:
    """Percent to target as a ratio (1.0 = on target); NULL for a zero or NULL target."""
    return safe_divide(actual, target)


def weighted_total(terms: Sequence[tuple[Column, Column]], null_as_zero: bool = True,
                   normalize: str = "fixed") -> Column:
    """Role-weighted score from ``(pct, weight_pct)`` pairs, added in the given order.

    ``null_as_zero=True`` is the employee form: each ratio and weight is
    coalesced to 0, so the score is never NULL.  ``False`` is the branch form:
    one NULL ratio or weight makes the whole score NULL.

    ``normalize="fixed"`` divides by 100; ``"applicable"`` divides the sum by
    the total weight of the pillars whose ratio is not NULL (NULL when none).
    """
    total = None
    for pct, weight in terms:
        if null_as_zero:
            term = F.coalesce(pct, F.lit(0.0)) * F.coalesce(weight, F.lit(0.0))
        else:
            term = pct * weight
        total = term if total is None else total + term
    if normalize == "fixed":
        return total / F.lit(100.0)
    if normalize == "applicable":
        wsum = None
        for pct, weight in terms:
            w = F.when(pct.isNotNull(), F.coalesce(weight, F.lit(0.0))).otherwise(F.lit(0.0))
            wsum = w if wsum is None else wsum + w
        return safe_divide(total, wsum)
    raise ValueError(f"normalize must be 'fixed' or 'applicable', got {normalize!r}")


def rag_status(score: Column | str, green: float = GREEN_AT, amber: float = AMBER_AT) -> Column:
    """Green at or above ``green``, Amber at or above ``amber``, else Red (NULL is Red)."""
    s = _c(score)
    return (F.when(s >= F.lit(green), F.lit("Green"))
            .when(s >= F.lit(amber), F.lit("Amber"))
            .otherwise(F.lit("Red")))


def clamp(value: Column | str, low: float, high: float) -> Column:
    """Bound a value to ``[low, high]``; NULL stays NULL (greatest/least alone would not)."""
    v = _c(value)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def out_of_range(value: Column | str, low: float, high: float) -> Column:
    """True when a non-NULL value lies outside ``[low, high]``."""
    v = _c(value)
    return v.isNotNull() & ~v.between(F.lit(low), F.lit(high))
