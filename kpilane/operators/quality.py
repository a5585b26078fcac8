"""Data-quality and reconciliation jobs.  Each returns a small report DataFrame;
all work is aggregates and joins of aggregates (no pair emission, no collect)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.functions.scoring import out_of_range
from kpilane.operators.branch import exact_sum
from kpilane.operators.joins import join_null_safe


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def view_row_counts(views: Mapping[str, DataFrame]) -> DataFrame:
    """view_name, row_count for each named view."""
    return _union([v.agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(name).alias("view_name"), "row_count") for name, v in views.items()])


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key has no parent row (left anti join on distinct parent keys)."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def referential_integrity(pairs: Sequence[tuple[str, DataFrame, str, DataFrame, Sequence[str]]]) -> DataFrame:
    """check, child_rows, orphan_rows for each ``(child_name, child, parent_name, parent, keys)``.

    Child rows are counted per key before the join, so a key holding most of
    the child rows is one row when it meets the (distinct) parent keys.
    """
    reports = []
    for child_name, child, parent_name, parent, keys in pairs:
        per_key = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        flagged = per_key.join(parent.select(*keys).distinct().withColumn("_found", F.lit(True)),
                               list(keys), "left")
        reports.append(flagged.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("child_rows"),
            F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_n"))), F.lit(0)).cast("bigint")
            .alias("orphan_rows"),
        ).select(F.lit(f"{child_name} -> {parent_name} on {', '.join(keys)}").alias("check_name"),
                 "child_rows", "orphan_rows"))
    return _union(reports)


def target_range_check(checks: Sequence[tuple[str, DataFrame, Sequence[tuple[str, float, float | None]]]]) -> DataFrame:
    """table_name, column_name, low, high, rows_checked, out_of_range, min_value, max_value.

    One aggregate per table covers all its columns; rows are then unfolded.  A ``high`` of
    None is no bound: what a usual amount is depends on tier and role (:func:`target_outliers`).
    """
    reports = []
    for table, df, bounds in checks:
        aggs = []
        for col, lo, hi in bounds:
            aggs += [F.count(F.col(col)).alias(f"{col}__n"),
                     F.count_if(out_of_range(col, lo, hi) if hi is not None else F.col(col) < lo).alias(f"{col}__bad"),
                     F.min(col).cast("double").alias(f"{col}__min"),
                     F.max(col).cast("double").alias(f"{col}__max")]
        agg = df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(col).alias("column_name"), F.lit(float(lo)).alias("low"),
                                  F.lit(hi).cast("double").alias("high"),
                                  F.col(f"{col}__n").alias("rows_checked"),
                                  F.col(f"{col}__bad").alias("out_of_range"),
                                  F.col(f"{col}__min").alias("min_value"),
                                  F.col(f"{col}__max").alias("max_value"))
                         for col, lo, hi in bounds])
        reports.append(agg.select(F.lit(table).alias("table_name"), F.inline(rows)))
    return _union(reports)


def target_outliers(facts: DataFrame, columns: Sequence[str], groups: Sequence[str] = ("tier", "role"),
                    fence: float = 3.0, accuracy: int = 10_000) -> DataFrame:
    """column_name, the groups, low, high, rows_checked, out_of_range, min_value, max_value.

    The usual range of a target lies within ``fence`` quartile distances of the quartiles of its own tier and role.
    Quartiles come from a mergeable quantile sketch (``percentile_approx``: rank error at most 1 / ``accuracy``, exact
    for fewer rows than that), so a group of any size is one small state per task.  The bounds, a
    row per group, then join the facts, which are counted in one aggregate.
    """
    groups = list(groups)
    rows = facts.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_m"))
    rows = rows.select(*groups, "_m.*")
    quartile = F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy))
    bounds = rows.groupBy("column_name", *groups).agg(quartile.alias("_q")).select(
        "column_name", *groups, (F.col("_q")[0] - fence * (F.col("_q")[1] - F.col("_q")[0])).alias("low"),
        (F.col("_q")[1] + fence * (F.col("_q")[1] - F.col("_q")[0])).alias("high"))
    checked = join_null_safe(rows, bounds, ["column_name", *groups], "inner")
    return checked.groupBy("column_name", *groups).agg(
        F.min("low").alias("low"), F.min("high").alias("high"), F.count("value").alias("rows_checked"),
        F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("out_of_range"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def key_uniqueness(checks: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """table_name, key_columns, total_rows, distinct_keys, duplicate_keys, rows_in_duplicates."""
    reports = []
    for name, df, keys in checks:
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        reports.append(per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("bigint").alias("rows_in_duplicates"),
        ).select(F.lit(name).alias("table_name"), F.lit(", ".join(keys)).alias("key_columns"),
                 "total_rows", "distinct_keys", "duplicate_keys", "rows_in_duplicates"))
    return _union(reports)


def join_fanout(checks: Sequence[tuple[str, DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """check_name, left_rows, joined_rows, extra_rows for an inner join on ``keys``.

    The joined row count is Σ_k left(k)·right(k) over per-key counts, so a
    many-to-many join is measured without producing its pairs.
    """
    reports = []
    for name, left, right, keys in checks:
        lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
        rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
        joined = lc.join(rc, list(keys), "left")
        reports.append(joined.agg(
            F.coalesce(F.sum("_l"), F.lit(0)).cast("bigint").alias("left_rows"),
            F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).cast("bigint").alias("joined_rows"),
        ).select(F.lit(name).alias("check_name"), "left_rows", "joined_rows",
                 (F.col("joined_rows") - F.col("left_rows")).alias("extra_rows")))
    return _union(reports)


def totals_reconciliation(checks: Sequence[tuple[str, DataFrame, str, DataFrame, Sequence[str]]]) -> DataFrame:
    """check_name, total_a, total_b, difference for Σ a.col vs Σ b.col (exact sums) of every
    ``(name_a, a, name_b, b, columns)``.

    Each side is one global aggregate of all its columns (one scan, one row), unfolded after it.
    """
    totals = []
    for name_a, a, name_b, b, columns in checks:
        for side, df in (("a", a), ("b", b)):
            sums = df.agg(*[exact_sum(F.col(c).cast("double")).alias(c) for c in columns])
            rows = F.array(*[F.struct(F.lit(f"{c}: {name_a} vs {name_b}").alias("check_name"), F.col(c).alias("total"))
                             for c in columns])
            totals.append(sums.select(F.inline(rows)).withColumn("side", F.lit(side)))
    both = _union(totals).groupBy("check_name").agg(
        F.max(F.when(F.col("side") == "a", F.col("total"))).alias("total_a"),
        F.max(F.when(F.col("side") == "b", F.col("total"))).alias("total_b"))
    return both.withColumn("difference", F.coalesce("total_a", F.lit(0.0)) - F.coalesce("total_b", F.lit(0.0)))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
              tol: float = 5e-5) -> DataFrame:
    """Align two results on ``keys`` (full outer, NULL-safe) and classify each key.

    status: ``left_only`` / ``right_only`` / ``match`` (every column equal to
    ``tol``, i.e. to 4 decimals, NULL matching NULL) / ``differ``.
    """
    keys = list(keys)
    la = a.select(*keys, *[F.col(c).alias(f"a__{c}") for c in cols]).withColumn("_a", F.lit(True))
    rb = b.select(*[F.col(k).alias(f"r__{k}") for k in keys],
                  *[F.col(c).alias(f"b__{c}") for c in cols]).withColumn("_b", F.lit(True))
    j = la.join(rb, [la[k].eqNullSafe(rb[f"r__{k}"]) for k in keys], "full_outer")
    # a right-only row has NULL left keys: take the right side's
    j = j.select(*[F.when(F.col("_a").isNull(), F.col(f"r__{k}")).otherwise(F.col(k)).alias(k) for k in keys],
                 *[c for c in j.columns if c not in keys and not c.startswith("r__")])
    diffs = [F.abs(F.col(f"a__{c}") - F.col(f"b__{c}")) for c in cols]
    same = [F.col(f"a__{c}").isNull() & F.col(f"b__{c}").isNull() | (d <= F.lit(tol))
            for c, d in zip(cols, diffs)]
    all_same = reduce(lambda x, y: x & y, [F.coalesce(s, F.lit(False)) for s in same])
    status = (F.when(F.col("_b").isNull(), F.lit("left_only"))
              .when(F.col("_a").isNull(), F.lit("right_only"))
              .when(all_same, F.lit("match")).otherwise(F.lit("differ")))
    max_diff = F.greatest(*[F.coalesce(d, F.lit(0.0)) for d in diffs]) if len(diffs) > 1 else F.coalesce(diffs[0], F.lit(0.0))
    return j.select(*keys, status.alias("status"), max_diff.alias("max_abs_diff"))


def rank_consistency(ranked: DataFrame, contexts: Mapping[str, Sequence[str]], score: str) -> DataFrame:
    """rank_column, rows_ranked, distinct_ranks, broken_ranks, unstarted for each ``{rank column: keys}``.

    Checks RANK (score DESC, NULLs last) without ranking again. The ``n`` rows of rank ``r`` of a
    key must share one score, and the rank ``r + n`` must exist with a lower score unless all rows
    of the key are counted by then; ``broken_ranks`` are those that fail. ``unstarted`` are keys
    without a rank 1. Joins of (key, rank) counts only: no sort, no group in one task.
    """
    reports = []
    for name, keys in contexts.items():
        keys = list(keys)
        at = ranked.groupBy(*keys, F.col(name).alias("_rank")).agg(
            F.count(F.lit(1)).alias("_n"), F.count(score).alias("_scored"),
            F.min(score).alias("_low"), F.max(score).alias("_high"))
        total = at.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_rank").alias("_first"))
        after = at.select(*keys, F.col("_rank").alias("_next"), F.col("_high").alias("_next_high"),
                          F.lit(True).alias("_found"))
        steps = join_null_safe(at.withColumn("_next", F.col("_rank") + F.col("_n")), after, [*keys, "_next"], "left")
        steps = join_null_safe(steps, total, keys, "inner")
        one_score = (F.col("_scored") == 0) | ((F.col("_scored") == F.col("_n")) & (F.col("_low") == F.col("_high")))
        falls = F.col("_found") & (F.col("_scored") > 0) & (F.col("_next_high").isNull()
                                                            | (F.col("_next_high") < F.col("_low")))
        follows = F.when(F.col("_next") > F.col("_total"), F.col("_found").isNull()).otherwise(
            F.coalesce(falls, F.lit(False)))
        broken = steps.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows_ranked"),
                           F.count(F.lit(1)).alias("distinct_ranks"),
                           F.count_if(~(one_score & follows)).alias("broken_ranks"),
                           F.count_if((F.col("_rank") == F.col("_first")) & (F.col("_first") != 1)).alias("unstarted"))
        reports.append(broken.select(F.lit(name).alias("rank_column"), *broken.columns))
    return _union(reports)


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """status, key_count, max_abs_diff."""
    return reconciled.groupBy("status").agg(F.count(F.lit(1)).alias("key_count"),
                                            F.max("max_abs_diff").alias("max_abs_diff"))


def weight_sum_check(weights: DataFrame, employees: DataFrame | None = None,
                     expected: float = 100.0) -> DataFrame:
    """role, total_weight, pillar_rows, sums_to_expected (+ employees).

    With ``employees`` the check runs for every role present in the workforce
    (counted per role): a role that has people but no weight rows shows a NULL
    total and ``sums_to_expected = false``.
    """
    totals = weights.groupBy("role").agg(
        F.sum("weight_pct").alias("total_weight"),
        F.count(F.lit(1)).alias("pillar_rows"),
    )
    if employees is None:
        return totals.withColumn("sums_to_expected", F.col("total_weight") == F.lit(expected))
    staff = employees.groupBy("role").agg(F.count(F.lit(1)).alias("employees"))
    out = staff.join(totals, "role", "left")
    return out.select(
        "role", "employees", "total_weight",
        F.coalesce(F.col("pillar_rows"), F.lit(0)).alias("pillar_rows"),
        F.coalesce(F.col("total_weight") == F.lit(expected), F.lit(False)).alias("sums_to_expected"))


def active_staff(facts: Sequence[DataFrame]) -> DataFrame:
    """employee_id, branch_id, role of everybody with a row in one of the facts, once each."""
    return _union([f.select("employee_id", "branch_id", "role") for f in facts]).distinct()


def headcount_check(branches: DataFrame, employees: DataFrame) -> DataFrame:
    """Declared headcounts of each branch against its employees, one row each in ``employees``.

    To check anything, the two must come from different sources: the people seen at work in the facts
    (:func:`active_staff`) against the counts that the branch dimension declares.
    """
    role = F.col("role")
    actual = employees.groupBy("branch_id").agg(
        F.count_if(role == "Manager").cast("int").alias("actual_managers"),
        F.count_if(role == "Advisor").cast("int").alias("actual_advisors"),
        F.count_if(role == "Teller").cast("int").alias("actual_tellers"),
        F.count(F.lit(1)).cast("int").alias("actual_employees"))
    j = branches.select("branch_id", "manager_count", "advisor_count", "teller_count",
                        "employee_count").join(actual, "branch_id", "left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
              ("actual_managers", "actual_advisors", "actual_tellers", "actual_employees")]
    j = j.select("branch_id", "manager_count", "advisor_count", "teller_count", "employee_count", *filled)
    ok: Column = ((F.col("manager_count") == F.col("actual_managers"))
                  & (F.col("advisor_count") == F.col("actual_advisors"))
                  & (F.col("teller_count") == F.col("actual_tellers"))
                  & (F.col("employee_count") == F.col("actual_employees")))
    return j.withColumn("headcount_matches", F.coalesce(ok, F.lit(False)))
