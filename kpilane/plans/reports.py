"""Dashboard pages restated as queries: top advisors, pillar detail, branch team,
leaderboards, province performance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.functions.scoring import rag_status
from kpilane.operators.ranking import MAX_CANDIDATES, rank_by, rank_of_rows, top_n_by_rank
from kpilane.operators.weights import weight_scalars
from kpilane.operators.weights_long import weights_long
from kpilane.schemas import BRANCH_PILLARS, period_columns


TOP_ADVISOR_COLUMNS = ("employee_id", "branch_id", "branch_code", "first_name", "last_name",
                       "weighted_total_score", "rank_within_role", "rank_within_branch")


def latest_period(scores: DataFrame) -> dict[str, Column]:
    """The last period that ``scores`` has rows of, one scalar-subquery column per period column."""
    period = period_columns(scores)
    last = scores.agg(F.max(F.struct(*period))).scalar()
    return {c: last.getField(c) for c in period}


def top_advisors(scores: DataFrame, n: int = 3, role: str = "Advisor") -> DataFrame:
    """Top ``n`` of ``role`` in the latest period that role has scores for, with both ranks.

    The latest (year and) month is a scalar subquery over the key columns. Each period column is compared with its
    part of it, so that a star stored by period is read in that period's folders only. The top-k is a
    ``TakeOrderedAndProject``
    (each task keeps ``n`` rows; ties broken by employee id).  The two ranks of
    those ``n`` rows are then counted against the period (a broadcast of
    ``n`` rows, ``MAX_CANDIDATES`` at most), so no full ranking of the workforce is needed and nothing is stored.
    """
    if not 0 < n <= MAX_CANDIDATES:
        raise ValueError(f"n must lie between 1 and {MAX_CANDIDATES}, got {n}")
    period = period_columns(scores)
    latest = latest_period(scores.filter(F.col("role") == role))
    for c in period:
        scores = scores.filter(F.col(c) == latest[c])
    top = (scores.filter(F.col("role") == role)
           .orderBy(F.col("weighted_total_score").desc_nulls_last(), F.col("employee_id").asc())
           .limit(n))
    contexts = {"rank_within_role": ["role", *period], "rank_within_branch": ["branch_id", *period]}
    ranked = rank_of_rows(top, scores, contexts, "weighted_total_score", ["employee_id", *period], at_most=n)
    return ranked.select(*TOP_ADVISOR_COLUMNS)


def pillar_detail(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Per employee, month and applicable pillar: ratio, weight and contribution.

    Joining through the weights (inner) drops every pillar the role has no
    weight row for; ``contribution = pct * weight / 100`` sums to the score.
    """
    wl = weights_long(weights).select("role", "pillar_name", "weight_pct")
    return long.join(wl, ["role", "pillar_name"]).select(
        "employee_id", "branch_id", "role", *period_columns(long), "pillar_name", "pct_to_target",
        "weight_pct", (F.col("pct_to_target") * F.col("weight_pct") / F.lit(100.0)).alias("contribution"),
        "weighted_total_score")


def branch_pillars(weights: DataFrame) -> Column:
    """The branch's five pillars as one column: pillar_name, pct_to_target, weight_pct, rag_status in pillar order."""
    w = weight_scalars(weights)
    return F.array(*[F.struct(F.lit(p.long_label).alias("pillar_name"),
                              F.col(f"{p.key}_pct_to_target").alias("pct_to_target"), w[p.key].alias("weight_pct"),
                              rag_status(f"{p.key}_pct_to_target").alias("rag_status")) for p in BRANCH_PILLARS])


def branch_team(ranked: DataFrame, branch_ranked: DataFrame, branch_id: int | None = None,
                weights: DataFrame | None = None) -> DataFrame:
    """Branch page: the branch's band, score and rank next to each team member.

    With ``weights`` the page also has the branch's ``pillars`` (:func:`branch_pillars`).
    Both sides are keyed by (branch, period), so this is one co-partitioned join.
    """
    period = period_columns(ranked)
    pillars = [branch_pillars(weights).alias("pillars")] if weights is not None else []
    b = branch_ranked.select(
        "branch_id", *period, "branch_code", "branch_name", "tier", "rag_status",
        F.col("weighted_total_score").alias("branch_score"), "branch_rank", *pillars)
    e = ranked.select("branch_id", *period, "employee_id", "role", "first_name", "last_name",
                      F.col("weighted_total_score").alias("employee_score"), "rank_within_branch")
    if branch_id is not None:
        b = b.filter(F.col("branch_id") == branch_id)
        e = e.filter(F.col("branch_id") == branch_id)
    return b.join(e, ["branch_id", *period])


def leaderboard_employees(scores: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` employees per role and period (rank <= n; ties kept)."""
    period = period_columns(scores)
    top = top_n_by_rank(scores, ["role", *period], "weighted_total_score", n, "leaderboard_rank")
    return top.select("role", *period, "leaderboard_rank", "employee_id", "branch_id",
                      "branch_code", "weighted_total_score")


def leaderboard_branches(branch_scores: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` branches per period (rank <= n; ties kept)."""
    period = period_columns(branch_scores)
    top = top_n_by_rank(branch_scores, period, "weighted_total_score", n, "leaderboard_rank")
    return top.select(*period, "leaderboard_rank", "branch_id", "branch_code", "branch_name",
                      "tier", "weighted_total_score")


def branch_rank_in_province(star: Mapping[str, DataFrame], pacing: DataFrame) -> DataFrame:
    """Branches ranked within their province and period."""
    period = period_columns(pacing)
    prov = star["dim_branch"].select("branch_id", "province")
    with_prov = pacing.join(prov, "branch_id")
    ranked = rank_by(with_prov, ["province", *period], "weighted_total_score", "province_rank")
    return ranked.select("province", *period, "province_rank", "branch_id", "branch_code",
                         "weighted_total_score", "rag_status")
