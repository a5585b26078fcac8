"""Role weights: long -> wide pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.schemas import BRANCH_PILLARS, EMPLOYEE_PILLARS, Pillar


def _weight_of(p: Pillar) -> Column:
    return F.max(F.when(F.col("metric_name") == p.weight_metric, F.col("weight_pct"))).alias(f"{p.key}_weight")


def role_weights_pivot(weights: DataFrame, pillars: Sequence[Pillar] = EMPLOYEE_PILLARS) -> DataFrame:
    """One row per role with ``<pillar>_weight`` columns (MAX on duplicate rows, NULL if absent).

    A conditional aggregate per pillar: a pivot over a fixed value list in a
    single hash aggregate (``groupBy().pivot()`` would add a second one).
    """
    return weights.groupBy("role").agg(*[_weight_of(p) for p in pillars])


def manager_weights(weights: DataFrame, pillars: Sequence[Pillar] = BRANCH_PILLARS,
                    role: str = "Manager") -> DataFrame:
    """Global aggregate over the Manager's rows: always exactly one row (all NULL if none)."""
    return weights.filter(F.col("role") == role).agg(*[_weight_of(p) for p in pillars])


def workforce_weights(weights: DataFrame, employees: DataFrame) -> DataFrame:
    """The weight rows of the roles present in the workforce (a left-semi join on its distinct roles)."""
    return weights.join(employees.select("role").distinct(), "role", "left_semi")


def weight_scalars(weights: DataFrame, pillars: Sequence[Pillar] = BRANCH_PILLARS,
                   role: str = "Manager") -> dict[str, Column]:
    """The one-row Manager weights as scalar-subquery columns (no join needed).

    One struct-valued subquery referenced once per pillar: Spark evaluates the
    identical subquery once and reuses it.
    """
    mw = manager_weights(weights, pillars, role)
    packed = mw.select(F.struct(*[f"{p.key}_weight" for p in pillars]).alias("w")).scalar()
    return {p.key: packed.getField(f"{p.key}_weight") for p in pillars}
