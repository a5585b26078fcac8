from pyspark.sql import functions as F

from kpilane.operators import branch as br
from kpilane.operators import measures as ms
from kpilane.operators import quality as qa
from kpilane.plans.catalog import RANGE_CHECKS
from kpilane.plans.oracle import RANGE_CHECKS as ORACLE_RANGES


def test_referential_integrity_finds_orphans(golden):
    rep = qa.referential_integrity([
        ("fact_sales", golden["fact_sales"], "dim_employee", golden["dim_employee"], ["employee_id"]),
        ("fact_sales", golden["fact_sales"], "fact_targets", golden["fact_targets"],
         ["employee_id", "month_number"]),
    ]).collect()
    assert [(r.child_rows, r.orphan_rows) for r in rep] == [(11, 2), (11, 1)]
    assert sorted(r.employee_id for r in qa.orphans(golden["fact_sales"], golden["dim_employee"],
                                                    ["employee_id"]).collect()) == [8, 9]


def test_key_uniqueness_and_fanout(spark, golden):
    dup = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "k long, v long")
    r = qa.key_uniqueness([("t", dup, ["k", "v"])]).collect()[0]
    assert (r.total_rows, r.distinct_keys, r.duplicate_keys, r.rows_in_duplicates) == (4, 3, 1, 2)
    right = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k long")
    f = qa.join_fanout([("x", dup, right, ["k"])]).collect()[0]
    assert (f.left_rows, f.joined_rows, f.extra_rows) == (4, 9, 5)


def test_range_check(spark):
    df = spark.createDataFrame([(0.5,), (3.0,), (None,), (6.0,)], "x double")
    r = qa.target_range_check([("t", df, [("x", 1.0, 5.0)])]).collect()[0]
    assert (r.rows_checked, r.out_of_range, r.min_value, r.max_value) == (3, 2, 0.5, 6.0)


def test_totals_and_reconcile(golden):
    sides = [("fact_sales", golden["fact_sales"], "branch_sales", br.branch_sales(golden["fact_sales"]),
              ["lending_actual", "investing_actual"])]
    tot = {r.check_name: r for r in qa.totals_reconciliation(sides).collect()}
    lend = tot["lending_actual: fact_sales vs branch_sales"]
    assert len(tot) == 2 and lend.total_a == lend.total_b == 11660.0 and lend.difference == 0.0
    plan = qa.totals_reconciliation(sides)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # a leg for each side, whatever the number of columns
    keys = ["branch_id", "month_number"]
    rec = qa.reconcile(ms.measure_by_grain(golden, keys), br.branch_monthly_score(golden), keys,
                       ms.MEASURE_COLUMNS)
    assert {r.status for r in rec.collect()} == {"match"}
    summary = {r.status: r.key_count for r in qa.reconcile_summary(rec).collect()}
    assert summary == {"match": 3}
    shifted = br.branch_monthly_score(golden).withColumn(
        "weighted_total_score", F.col("weighted_total_score") + F.lit(1e-3))
    rec2 = {r.branch_id: r.status for r in qa.reconcile(br.branch_monthly_score(golden), shifted, keys,
                                                         ["weighted_total_score"]).collect()}
    assert rec2 == {1: "differ", 2: "differ", 3: "match"}  # NULL matches NULL
    only_left = qa.reconcile(br.branch_monthly_score(golden),
                             br.branch_monthly_score(golden).filter("branch_id <> 2"), keys,
                             ["weighted_total_score"])
    assert {r.branch_id: r.status for r in only_left.collect()}[2] == "left_only"


def test_weight_and_headcount_checks(golden):
    w = {r.role: (r.total_weight, r.sums_to_expected) for r in qa.weight_sum_check(golden["dim_role_weights"]).collect()}
    assert w == {"Advisor": (100.0, True), "Teller": (100.0, True), "Manager": (100.0, True)}
    staffed = {r.role: (r.employees, r.sums_to_expected) for r in
               qa.weight_sum_check(golden["dim_role_weights"], golden["dim_employee"]).collect()}
    assert staffed == {"Manager": (2, True), "Advisor": (4, True), "Teller": (2, True), "Intern": (1, False)}
    hc = {r.branch_id: r.headcount_matches for r in qa.headcount_check(golden["dim_branch"],
                                                                        golden["dim_employee"]).collect()}
    assert hc == {1: False, 2: False, 3: False}  # the fixture declares 1/1/1 per branch


def test_headcounts_come_from_the_facts(golden):
    staff = qa.active_staff([golden["fact_sales"], golden["fact_targets"]])
    assert staff.count() == staff.select("employee_id").distinct().count()
    counted = {(r.branch_id, r.role): r["count"] for r in staff.groupBy("branch_id", "role").count().collect()}
    declared = golden["dim_branch"]
    for role in ("Manager", "Advisor", "Teller"):
        of = F.create_map(*[F.lit(x) for b in (1, 2, 3) for x in (b, counted.get((b, role), 0))])
        declared = declared.withColumn(f"{role.lower()}_count", of[F.col("branch_id")].cast("int"))
    totals = F.create_map(*[F.lit(x) for b in (1, 2, 3) for x in (b, sum(n for (k, _), n in counted.items() if k == b))])
    declared = declared.withColumn("employee_count", totals[F.col("branch_id")].cast("int"))
    ok = {r.branch_id: r.headcount_matches for r in qa.headcount_check(declared, staff).collect()}
    assert ok == {1: True, 2: True, 3: True}
    # a planted mismatch: branch 2 declares one Advisor more than is seen at work
    planted = declared.withColumn("advisor_count", F.col("advisor_count") + F.when(F.col("branch_id") == 2, 1).otherwise(0))
    ok = {r.branch_id: r.headcount_matches for r in qa.headcount_check(planted, staff).collect()}
    assert ok == {1: True, 2: False, 3: True}


def test_planted_target_is_an_outlier_of_its_tier_and_role(spark):
    rows = [("Small", "Advisor", 100.0 + i) for i in range(40)] + [("Large", "Advisor", 9000.0 + i) for i in range(40)]
    rows += [("Small", "Advisor", 9010.0), (None, "Teller", 5.0), (None, "Teller", None)]
    df = spark.createDataFrame(rows, "tier string, role string, target double")
    got = {(r.tier, r.role): r for r in qa.target_outliers(df, ["target"]).collect()}
    assert got["Small", "Advisor"].out_of_range == 1 and got["Small", "Advisor"].max_value == 9010.0
    assert got["Large", "Advisor"].out_of_range == 0  # the same amount is usual there
    assert got[None, "Teller"].rows_checked == 1
    assert qa.target_outliers(df.limit(0), ["target"]).collect() == []


def test_a_range_without_upper_bound(spark):
    df = spark.createDataFrame([(-1.0,), (1e12,), (None,)], "x double")
    r = qa.target_range_check([("t", df, [("x", 0.0, None)])]).collect()[0]
    assert (r.high, r.rows_checked, r.out_of_range) == (None, 2, 1)


def test_every_registered_range_has_two_ends(spark):
    wide = [(None,), (-1.0,), (0.0,), (1e9,), (2e9,), (float("nan"),)]
    for table, bounds in RANGE_CHECKS.items():
        columns = [c for c, _, _ in bounds]
        df = spark.createDataFrame(wide, "x double").select(*[F.col("x").alias(c) for c in columns])
        for r in qa.target_range_check([(table, df, bounds)]).collect():
            money = r.column_name in ("target_lending", "target_investing", "target_banking_units")
            assert r.high is not None and r.rows_checked == 5
            if money:
                assert (r.low, r.high, r.out_of_range) == (0.0, 1e9, 3), r  # below, above and NaN
    assert {t: [(c, float(lo), float(hi)) for c, lo, hi in b] for t, b in ORACLE_RANGES.items()} == RANGE_CHECKS


def test_empty_tables_count_zero(spark):
    none = spark.createDataFrame([], "k int, v int")
    r = qa.key_uniqueness([("t", none, ["k"])]).collect()[0]
    assert (r.total_rows, r.distinct_keys, r.duplicate_keys, r.rows_in_duplicates) == (0, 0, 0, 0)
    f = qa.join_fanout([("t", none, none, ["k"])]).collect()[0]
    assert (f.left_rows, f.joined_rows, f.extra_rows) == (0, 0, 0)


def test_measure_at_branch_grain_equals_branch_view(golden):
    keys = ["branch_id", "month_number"]
    m = {r.branch_id: r.weighted_total_score for r in ms.measure_by_grain(golden, keys).collect()}
    v = {r.branch_id: r.weighted_total_score for r in br.branch_monthly_score(golden).collect()}
    assert m == v


def test_measure_is_ratio_of_sums_under_filter(golden):
    rows = ms.measure_by_grain(golden, ["month_number"], where=F.col("tier") != "Large").collect()
    r = rows[0]
    assert abs(r.lending_pct_to_target - (3550 + 8110) / (4300 + 8110)) < 1e-12
    roll = ms.measure_rollup(golden, ["month_number", "tier"]).collect()
    levels = sorted({r.grouping_level for r in roll})
    assert levels == [0, 1, 3]


def test_scaling_actuals_and_targets_keeps_scores(golden):
    def scaled(df, cols):
        return df.select(*[(F.col(c) * 2).alias(c) if c in cols else F.col(c) for c in df.columns])
    s2 = dict(golden)
    s2["fact_sales"] = scaled(golden["fact_sales"], ["lending_actual", "investing_actual",
                                                     "banking_units_actual", "lei_actual"])
    s2["fact_targets"] = scaled(golden["fact_targets"], ["target_lending", "target_investing",
                                                         "target_banking_units", "target_lei",
                                                         "target_compliance"])
    s2["fact_compliance"] = scaled(golden["fact_compliance"], ["compliance_score"])
    a = {r.branch_id: r.weighted_total_score for r in br.branch_monthly_score(golden).collect()}
    b = {r.branch_id: r.weighted_total_score for r in br.branch_monthly_score(s2).collect()}
    for k in a:
        assert (a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-12


def test_rank_contexts(golden):
    from kpilane.operators import employee as emp
    s = emp.employee_monthly_score(golden)
    after = {r.employee_id: r.rank for r in
             ms.rank_all_except(s, ["role", "month_number"], "weighted_total_score",
                                F.col("branch_id") == 1).collect()}
    sel = {r.employee_id: r.rank for r in
           ms.rank_all_selected(s, ["role", "month_number"], "weighted_total_score",
                                F.col("branch_id") == 1).collect()}
    assert after == {1: 2, 2: 3, 3: 2, 10: 4}   # company-wide ranks, shown for branch 1
    assert sel == {1: 1, 2: 1, 3: 1, 10: 2}     # ranks among branch 1 only


def test_measure_at_role_grain(golden):
    rows = {r.role: r for r in ms.measure_by_grain(golden, ["role", "month_number"]).collect()}
    m = rows["Manager"]
    want = (30 * 1.0 + 30 * 1.0 + 15 * (660 + 740) / (600 + 740) + 10 * (3 + 4) / (4 + 4)) / 100
    assert abs(m.weighted_total_score - want) < 1e-12
    assert m.compliance_pct_to_target is None
    assert rows["Teller"].lending_pct_to_target is None and rows["Teller"].banking_units_pct_to_target is not None
    assert rows["Intern"].weighted_total_score == 0.0
    # orphan facts keep their (NULL) role: no weights, score 0
    assert rows[None].weighted_total_score == 0.0


def test_company_grain_equals_rollup_grand_total(golden):
    company = ms.measure_by_grain(golden, []).collect()
    assert len(company) == 1
    roll = {r.grouping_level: r for r in ms.measure_rollup(golden, ["month_number", "tier"]).collect()}
    top = roll[3]
    for c in ms.MEASURE_COLUMNS:
        a, b = company[0][c], top[c]
        assert (a is None and b is None) or abs(a - b) < 1e-12, c


def test_sums_keep_small_values(spark):
    import math

    from kpilane.operators.branch import exact_sum
    tiny = spark.range(1000).select(F.lit(1e-7).alias("x"))
    assert math.isclose(tiny.agg(exact_sum("x")).first()[0], 1e-4)
    money = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert money.agg(exact_sum("x")).first()[0] == 0.3
    assert spark.createDataFrame([(1e35,), (None,)], "x double").agg(exact_sum("x")).first()[0] == 1e35
    assert spark.createDataFrame([], "x double").agg(exact_sum("x")).first()[0] is None


def test_rank_consistency_finds_a_wrong_rank(spark):
    keys = {"r": ["k"]}
    rows = [("a", 3.0, 1), ("a", 3.0, 1), ("a", 2.0, 3), ("a", None, 4), (None, 1.0, 1)]
    schema = "k string, s double, r long"
    (good,) = qa.rank_consistency(spark.createDataFrame(rows, schema), keys, "s").collect()
    assert (good.rows_ranked, good.distinct_ranks, good.broken_ranks, good.unstarted) == (5, 4, 0, 0)
    for wrong in ([("a", 3.0, 1), ("a", 2.0, 3)], [("a", 1.0, 1), ("a", 2.0, 2)], [("a", 1.0, 1), ("a", 2.0, 1)],
                  [("a", None, 1), ("a", 2.0, 2)]):
        assert qa.rank_consistency(spark.createDataFrame(wrong, schema), keys, "s").first().broken_ranks > 0
    assert qa.rank_consistency(spark.createDataFrame([("a", 3.0, 2)], schema), keys, "s").first().unstarted == 1


def test_employee_grain_needs_the_role_and_equals_the_view(spark, golden):
    import pytest

    from kpilane.operators import employee as emp
    with pytest.raises(ValueError):
        ms.measure_by_grain(golden, ["employee_id", "month_number"])
    got = ms.measure_by_grain(golden, ["employee_id", "role", "month_number"])
    assert "rag_status" in got.columns
    keys = ["employee_id", "month_number"]
    statuses = {r.status for r in qa.reconcile(got, emp.employee_monthly_score(golden), keys,
                                               ["weighted_total_score"]).collect()}
    assert statuses <= {"match", "left_only"} and "match" in statuses
