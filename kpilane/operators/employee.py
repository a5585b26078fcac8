"""Employee x month views: pillar ratios and weighted score, ranks, long form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.functions.scoring import pct_to_target, weighted_total
from kpilane.operators.ranking import rank_many
from kpilane.operators.weights import role_weights_pivot
from kpilane.schemas import EMPLOYEE_PILLARS

EMPLOYEE_KEYS = ["employee_id", "branch_id", "branch_code", "role", "first_name", "last_name",
                 "month_number", "month_name"]
PCT_COLUMNS = [f"{p.key}_pct_to_target" for p in EMPLOYEE_PILLARS]
SCORE_COLUMNS = EMPLOYEE_KEYS + PCT_COLUMNS + ["weighted_total_score"]
RANK_CONTEXTS = {
    "rank_within_role": ["role", "month_number"],
    "rank_within_branch": ["branch_id", "month_number"],
}
# The reference keys periods by month number alone; data spanning several years
# passes e.g. ("year", "month_number") so joins and ranks do not mix years.
PERIOD = ("month_number",)


def _period(period_cols) -> tuple[list[str], list[str]]:
    period = list(period_cols)
    if "month_number" not in period:
        raise ValueError("period_cols must include month_number")
    return period, [c for c in period if c != "month_number"]


def rank_contexts(period_cols=PERIOD) -> dict[str, list[str]]:
    period, _ = _period(period_cols)
    return {"rank_within_role": ["role", *period], "rank_within_branch": ["branch_id", *period]}


def employee_monthly_score(star: Mapping[str, DataFrame], normalize: str = "fixed",
                           excluded_role: str = "Teller", period_cols=PERIOD) -> DataFrame:
    """Pillar percent-to-target and the role-weighted total per employee and month.

    Sales join targets on (employee, month) and the employee dimension on
    employee (inner: orphans drop out); weights join by role (left: a role
    without weight rows scores 0).  The excluded role gets NULL Lending and
    Investing ratios.  ``normalize`` is passed to :func:`weighted_total`.
    ``period_cols`` are the period keys of the fact join (extra ones, such as a
    year, come out just before ``month_number``).
    """
    period, extra = _period(period_cols)
    sales = star["fact_sales"].select(
        "employee_id", "branch_id", *period, "month_name",
        *[p.actual for p in EMPLOYEE_PILLARS])
    targets = star["fact_targets"].select("employee_id", *period,
                                          *[p.target for p in EMPLOYEE_PILLARS])
    employees = star["dim_employee"].select("employee_id", "branch_code", "role", "first_name",
                                            "last_name")
    # one row per role: never more rows than the weights table itself
    weights = role_weights_pivot(star["dim_role_weights"])

    rows = (sales.join(targets, ["employee_id", *period])
            .join(employees, "employee_id")
            .join(weights, "role", "left"))

    pcts, terms = [], []
    for p in EMPLOYEE_PILLARS:
        ratio = pct_to_target(F.col(p.actual), F.col(p.target))
        if p.teller_excluded:
            ratio = F.when(F.col("role") == excluded_role, F.lit(None).cast("double")).otherwise(ratio)
        pcts.append(ratio.alias(f"{p.key}_pct_to_target"))
        terms.append((ratio, F.col(f"{p.key}_weight")))
    score = weighted_total(terms, null_as_zero=True, normalize=normalize)
    keys = EMPLOYEE_KEYS[:6] + extra + EMPLOYEE_KEYS[6:]
    return rows.select(*keys, *pcts, score.alias("weighted_total_score"))


def employee_rank(scores: DataFrame, ties: str = "rank", method: str = "range",
                  period_cols=PERIOD) -> DataFrame:
    """Add rank_within_role (role, period) and rank_within_branch (branch, period), score DESC.
    """
    contexts = rank_contexts(period_cols)
    columns = scores.columns
    ranked = rank_many(scores, contexts, "weighted_total_score", ties=ties, method=method)
    return ranked.select(*columns, *contexts)


def _long_keep(pillar_key: str, pct: str, excluded_role: str):
    """Whether a pillar's ratio becomes a row of the long view (NULL counts as no)."""
    keep = F.col(pct).isNotNull()
    if any(p.key == pillar_key and p.teller_excluded for p in EMPLOYEE_PILLARS):
        keep = keep & F.coalesce(F.col("role") != F.lit(excluded_role), F.lit(False))
    return keep


def employee_scorecard_long(ranked: DataFrame, excluded_role: str = "Teller") -> DataFrame:
    """One row per employee, month and pillar with a non-NULL ratio.

    Works on the ranked view (rank columns are carried along) or on the plain
    score view.

    Lending and Investing rows also require ``role != excluded_role`` (a NULL
    role therefore loses them, as the inequality is not true for NULL).
    """
    ids = [c for c in ranked.columns if c not in PCT_COLUMNS]
    ranks = [c for c in RANK_CONTEXTS if c in ranked.columns]
    keys = [c for c in ids if c not in ranks and c != "weighted_total_score"]
    long = ranked.unpivot(ids, PCT_COLUMNS, "_pillar", "pct_to_target")
    labels = F.lit(None).cast("string")
    for p in reversed(EMPLOYEE_PILLARS):
        labels = F.when(F.col("_pillar") == f"{p.key}_pct_to_target", F.lit(p.long_label)).otherwise(labels)
    keep = None
    for p in EMPLOYEE_PILLARS:
        this = (F.col("_pillar") == f"{p.key}_pct_to_target") & _long_keep(p.key, "pct_to_target", excluded_role)
        keep = this if keep is None else keep | this
    long = long.filter(keep)
    return long.select(*keys, labels.alias("pillar_name"), "pct_to_target",
                       "weighted_total_score", *ranks)
