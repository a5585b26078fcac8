"""Measures evaluated at any grain and under any filter, and rank filter contexts.

A measure is a ratio of sums: numerators and denominators are summed at the
requested grain *after* the filter, then divided.  At (branch_id, month_number)
it reproduces the branch view exactly.  Grains are built from the branch
dimension's attributes (branch_id, branch_code, tier, province, city),
year, month_number, role and, with the role, employee_id.  Without a role the score uses the Manager's weights, as
the branch view does; with a role it uses that role's weights (see
:func:`measure_by_grain`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.functions.scoring import pct_to_target, rag_status, weighted_total
from kpilane.operators.branch import SumState, exact_sum
from kpilane.operators.ranking import rank_by
from kpilane.operators.weights import role_weights_pivot, weight_scalars
from kpilane.schemas import BRANCH_PILLARS, EMPLOYEE_PILLARS

GRAIN_COLUMNS = ("employee_id", "branch_id", "branch_code", "tier", "province", "city", "year", "month_number", "role")
MEASURE_COLUMNS = [f"{p.key}_pct_to_target" for p in BRANCH_PILLARS] + ["weighted_total_score"]


_BRANCH_ATTRS = ("branch_code", "tier", "province", "city")


def _with_branch_attrs(facts: DataFrame, branches: DataFrame) -> DataFrame:
    """Facts with the branch dimension's attributes (facts without a branch drop out)."""
    own = facts.drop(*[c for c in _BRANCH_ATTRS if c in facts.columns])
    return own.join(branches.select("branch_id", *_BRANCH_ATTRS), "branch_id")


def _check_grain(by: Sequence[str]) -> None:
    bad = [c for c in by if c not in GRAIN_COLUMNS]
    if bad:
        raise ValueError(f"unsupported grain columns {bad}; use {GRAIN_COLUMNS}")


def measure_sums(star: Mapping[str, DataFrame], by: Sequence[str], where: Column | None = None,
                 grouping: str = "groupby") -> DataFrame:
    """Σ actuals, Σ targets and Σ compliance at the grain, in one aggregate.

    The three facts are stacked (``unionByName``; each source fills only its
    own columns) and summed together, so there is one shuffle and no join.  A
    grain key is kept only when all three sources have rows for it, which is
    what joining three separate aggregates would give.

    A rollup first sums to the finest grain, as mergeable states (:class:`~kpilane.operators.branch.SumState`),
    and expands those few rows to the levels, not the facts' rows.
    """
    _check_grain(by)
    branches = star["dim_branch"]
    inputs = {
        "_a": (star["fact_sales"], [p.actual for p in EMPLOYEE_PILLARS]),
        "_t": (star["fact_targets"], [p.target for p in BRANCH_PILLARS]),
        "_c": (star["fact_compliance"], ["compliance_score"]),
    }
    parts = []
    for tag, (df, cols) in inputs.items():
        d = _with_branch_attrs(df, branches)
        if where is not None:
            d = d.filter(where)
        parts.append(d.select(*by, *cols, F.lit(1).alias(tag)))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    measures = [c for _, cols in inputs.values() for c in cols]
    if grouping == "rollup":
        states = {c: SumState(c) for c in measures}
        finest = stacked.groupBy(*by).agg(*[a for s in states.values() for a in s.of_rows()],
                                          *[F.count(tag).alias(f"{tag}_rows") for tag in inputs])
        g = finest.rollup(*by).agg(*[s.merged().alias(c) for c, s in states.items()],
                                   *[F.sum(f"{tag}_rows").alias(f"{tag}_rows") for tag in inputs],
                                   F.grouping_id().alias("grouping_level"))
    else:
        g = stacked.groupBy(*by).agg(*[exact_sum(c).alias(c) for c in measures],
                                     *[F.count(tag).alias(f"{tag}_rows") for tag in inputs])
    covered = (F.col("_a_rows") > 0) & (F.col("_t_rows") > 0) & (F.col("_c_rows") > 0)
    return g.filter(covered).drop(*[f"{tag}_rows" for tag in inputs])


def _score(df: DataFrame, star: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    w = weight_scalars(star["dim_role_weights"])
    ratios = {p.key: pct_to_target(F.col(p.actual), F.col(p.target)) for p in BRANCH_PILLARS}
    score = weighted_total([(ratios[p.key], w[p.key]) for p in BRANCH_PILLARS], null_as_zero=False)
    return df.select(*keys, *[ratios[p.key].alias(f"{p.key}_pct_to_target") for p in BRANCH_PILLARS],
                     score.alias("weighted_total_score"), rag_status(score).alias("rag_status"))


def measure_by_grain(star: Mapping[str, DataFrame], by: Sequence[str],
                     where: Column | None = None) -> DataFrame:
    """Pillar ratios, weighted score and its RAG band at grain ``by`` under filter ``where``.

    Grains without a role use the Manager's weights and all five pillars, as
    the branch view does.  A grain containing ``role`` scores like an employee
    of that role: four pillars, that role's weights, NULL-as-zero, Lending and
    Investing NULL for Tellers; compliance (a branch-level fact) is NULL there.
    """
    by = list(by)
    if "role" in by:
        return _role_measure(star, by, where)
    if "employee_id" in by:
        raise ValueError("an employee is scored with their role's weights: add role to the grain")
    return _score(measure_sums(star, by, where), star, by)


def _role_measure(star: Mapping[str, DataFrame], by: list[str], where: Column | None,
                  excluded_role: str = "Teller") -> DataFrame:
    _check_grain(by)
    branches = star["dim_branch"]
    parts = []
    for tag, table, cols in (("_a", "fact_sales", [p.actual for p in EMPLOYEE_PILLARS]),
                             ("_t", "fact_targets", [p.target for p in EMPLOYEE_PILLARS])):
        d = _with_branch_attrs(star[table], branches)
        if where is not None:
            d = d.filter(where)
        parts.append(d.select(*by, *cols, F.lit(1).alias(tag)))
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True)
    measures = [p.actual for p in EMPLOYEE_PILLARS] + [p.target for p in EMPLOYEE_PILLARS]
    sums = (stacked.groupBy(*by)
            .agg(*[exact_sum(c).alias(c) for c in measures], F.count("_a").alias("_na"), F.count("_t").alias("_nt"))
            .filter((F.col("_na") > 0) & (F.col("_nt") > 0)))
    weights = star["dim_role_weights"]
    pivot = role_weights_pivot(weights)
    rows = sums.join(pivot, "role", "left")
    terms, pcts = [], []
    for p in EMPLOYEE_PILLARS:
        ratio = pct_to_target(F.col(p.actual), F.col(p.target))
        if p.teller_excluded:
            ratio = F.when(F.col("role") == excluded_role, F.lit(None).cast("double")).otherwise(ratio)
        pcts.append(ratio.alias(f"{p.key}_pct_to_target"))
        terms.append((ratio, F.col(f"{p.key}_weight")))
    score = weighted_total(terms, null_as_zero=True)
    return rows.select(*by, *pcts, F.lit(None).cast("double").alias("compliance_pct_to_target"),
                       score.alias("weighted_total_score"), rag_status(score).alias("rag_status"))


def measure_rollup(star: Mapping[str, DataFrame], by: Sequence[str],
                   where: Column | None = None) -> DataFrame:
    """Like :func:`measure_by_grain` for every prefix of ``by`` in one pass (ROLLUP).

    ``grouping_level`` is Spark's ``grouping_id()`` (bit set = column rolled up),
    which also tells a rolled-up NULL from a NULL key value.
    """
    by = list(by)
    if "role" in by or "employee_id" in by:
        raise ValueError("measure_rollup supports branch and period grains; use measure_by_grain for role")
    return _score(measure_sums(star, by, where, grouping="rollup"), star, by + ["grouping_level"])


def rank_all_except(df: DataFrame, keep: Sequence[str], score: str, where: Column | None,
                    out_col: str = "rank") -> DataFrame:
    """Rank in an 'all except keep' filter context: rank every row within ``keep``, then filter."""
    ranked = rank_by(df, list(keep), score, out_col)
    return ranked if where is None else ranked.filter(where)


def rank_all_selected(df: DataFrame, keep: Sequence[str], score: str, where: Column | None,
                      out_col: str = "rank") -> DataFrame:
    """Rank in an 'all selected' filter context: filter first, then rank the selected rows."""
    selected = df if where is None else df.filter(where)
    return rank_by(selected, list(keep), score, out_col)
