"""Join helpers: NULL-safe equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), keeping the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    joined = left.join(renamed, on=cond, how=how)
    return joined.drop(*[f"__r_{k}" for k in keys])
