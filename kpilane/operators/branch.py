"""Branch x month views: pre-aggregated actuals and targets, Manager-weighted score, RAG, rank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.functions.scoring import pct_to_target, rag_status, weighted_total
from kpilane.operators.ranking import rank_by
from kpilane.operators.weights import weight_scalars
from kpilane.schemas import AMBER_AT, BRANCH_PILLARS, EMPLOYEE_PILLARS, GREEN_AT, period_columns

EXACT_SUM = "decimal(38,6)"


def exact_sum(col: str | Column) -> Column:
    """Sum of doubles without lost digits.

    Where every value of the group has at most six decimals, the sum goes through an exact
    decimal, so it does not depend on how rows were split across partitions (double addition
    is not associative). A group with finer values is summed as doubles.
    """
    c = F.col(col) if isinstance(col, str) else col
    exact = c.try_cast(EXACT_SUM)
    fits = c.isNull() | F.coalesce(exact.cast("double") == c, F.lit(False))
    return F.when(F.bool_and(fits), F.sum(exact).cast("double")).otherwise(F.sum(c))


class SumState:
    """An :func:`exact_sum` in two steps: states of the rows of a group, then of groups of groups."""

    def __init__(self, col: str) -> None:
        self.col = col
        self.exact, self.inexact, self.fits = f"{col}__exact", f"{col}__inexact", f"{col}__fits"

    def of_rows(self) -> list[Column]:
        c = F.col(self.col)
        exact = c.try_cast(EXACT_SUM)
        fits = c.isNull() | F.coalesce(exact.cast("double") == c, F.lit(False))
        return [F.sum(exact).cast(EXACT_SUM).alias(self.exact), F.sum(c).alias(self.inexact),
                F.bool_and(fits).alias(self.fits)]

    def merged(self) -> Column:
        return (F.when(F.bool_and(self.fits), F.sum(self.exact).cast("double")).otherwise(F.sum(self.inexact)))


def branch_sales(fact_sales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Σ actuals per branch and period (partial aggregate before the shuffle)."""
    keys = keys or ["branch_id", *period_columns(fact_sales)]
    return fact_sales.groupBy(*keys).agg(*[exact_sum(p.actual).alias(p.actual) for p in EMPLOYEE_PILLARS])


def branch_targets(fact_targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Σ targets (including the compliance target) per branch and period."""
    keys = keys or ["branch_id", *period_columns(fact_targets)]
    return fact_targets.groupBy(*keys).agg(*[exact_sum(p.target).alias(p.target) for p in BRANCH_PILLARS])


def branch_monthly_score(star: Mapping[str, DataFrame], period_cols=("month_number",)) -> DataFrame:
    """Ratio of sums per branch and period, scored with the Manager's weights.

    No COALESCE: one NULL ratio or weight makes the total NULL.  The Manager
    weights are one scalar subquery over the one-row global aggregate.
    ``period_cols`` must include ``month_number``; extra ones (a year) come out
    just before it.
    """
    period = list(period_cols)
    if "month_number" not in period:
        raise ValueError("period_cols must include month_number")
    extra = [c for c in period if c != "month_number"]
    keys = ["branch_id", *period]
    bs = branch_sales(star["fact_sales"], keys)
    bt = branch_targets(star["fact_targets"], keys)
    db = star["dim_branch"].select("branch_id", "branch_code", "branch_name", "tier")
    fc = star["fact_compliance"].select(*keys, "month_name", "compliance_score")
    w = weight_scalars(star["dim_role_weights"])

    rows = bs.join(bt, keys).join(db, "branch_id").join(fc, keys)
    ratios = {p.key: pct_to_target(F.col(p.actual), F.col(p.target)) for p in BRANCH_PILLARS}
    score = weighted_total([(ratios[p.key], w[p.key]) for p in BRANCH_PILLARS], null_as_zero=False)
    return rows.select(
        "branch_id", "branch_code", "branch_name", "tier", *extra, "month_number", "month_name",
        *[ratios[p.key].alias(f"{p.key}_pct_to_target") for p in BRANCH_PILLARS],
        score.alias("weighted_total_score"))


def branch_pacing(branch_scores: DataFrame, green: float = GREEN_AT, amber: float = AMBER_AT) -> DataFrame:
    """Add the RAG band (NULL score -> Red)."""
    return branch_scores.withColumn("rag_status", rag_status("weighted_total_score", green, amber))


def branch_rank(pacing: DataFrame, ties: str = "rank", method: str = "range",
                keys: list[str] | None = None, out_col: str = "branch_rank") -> DataFrame:
    """Rank branches company-wide per period by weighted score (NULL scores last).

    ``keys`` defaults to the period: ``month_number``, plus ``year`` when present.
    """
    return rank_by(pacing, keys or period_columns(pacing), "weighted_total_score", out_col,
                   ties=ties, method=method)
