"""The layered scorecard views as named SQL views (``createOrReplaceTempView``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from kpilane.operators import branch as br
from kpilane.operators import employee as emp
from kpilane.plans.reports import TOP_ADVISOR_COLUMNS
from kpilane.schemas import period_columns

VIEW_NAMES = ("vw_employee_monthly_score", "vw_employee_rank", "vw_employee_scorecard_long",
              "vw_branch_monthly_score", "vw_branch_pacing")


def build_views(star: Mapping[str, DataFrame], ties: str = "rank") -> dict[str, DataFrame]:
    """The five views, layered: score -> rank -> long; branch score -> pacing.

    They are plans: nothing runs until one is queried, and each query sees the star's rows of
    that time. Ranks are found by fixed cells of the score, which need no stored job.
    """
    period = period_columns(star["fact_sales"])
    scores = emp.employee_monthly_score(star, period_cols=period)
    ranked = emp.employee_rank(scores, ties=ties, method="cells", period_cols=period)
    branch = br.branch_monthly_score(star, period_cols=period)
    return {
        "vw_employee_monthly_score": scores,
        "vw_employee_rank": ranked,
        "vw_employee_scorecard_long": emp.employee_scorecard_long(ranked),
        "vw_branch_monthly_score": branch,
        "vw_branch_pacing": br.branch_pacing(branch),
    }


def register_views(spark: SparkSession, star: Mapping[str, DataFrame], ties: str = "rank") -> dict[str, DataFrame]:
    """Register the seven tables and five views under their names (replacing earlier ones),
    so ad-hoc SQL such as ``spark.sql(q, args={...})`` can run against them."""
    for name, df in star.items():
        df.createOrReplaceTempView(name)
    views = build_views(star, ties)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def top_advisors_sql(spark: SparkSession, month: int, role: str = "Advisor", n: int = 3,
                     year: int | None = None) -> DataFrame:
    """The best ``n`` of a role in a period, with bound parameters over the registered views.

    Views that carry a year need one: a month of all years together has no ranking.
    """
    columns = spark.table("vw_employee_rank").columns
    if ("year" in columns) != (year is not None):
        raise ValueError("the views carry a year: give one" if year is None else "the views carry no year")
    period = "month_number = :month" + ("" if year is None else " AND year = :year")
    args = {"role": role, "month": month, "n": n} | ({} if year is None else {"year": year})
    return spark.sql(
        f"SELECT {', '.join(TOP_ADVISOR_COLUMNS)} FROM vw_employee_rank WHERE {period} AND role = :role "
        "ORDER BY weighted_total_score DESC, employee_id LIMIT :n", args=args)
