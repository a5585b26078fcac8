"""The star and the views stored by period, refreshed by period, and read by period."""

import os

import pytest
from pyspark.sql import functions as F

from kpilane.operators import branch as br
from kpilane.operators import employee as emp
from kpilane.plans.reports import branch_team, top_advisors
from kpilane.plans.views import VIEW_NAMES, build_views, register_views, top_advisors_sql
from kpilane.schemas import PERIOD_TABLES
from kpilane.sources.star import (export_views, load_star, read_role_weights, replace_periods, role_weights_frame,
                                  save_star, write_csv)
from tests.test_periods import PERIOD, _two_years


def _jobs(spark):
    """Jobs started so far, as the status store of this session counts them."""
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_export_refresh_keeps_the_same_month_of_another_year(spark, golden, tmp_path):
    view = br.branch_pacing(br.branch_monthly_score(_two_years(golden), period_cols=PERIOD))
    paths = export_views({"v": view}, str(tmp_path))
    assert os.path.isdir(os.path.join(paths["v"], "year=2024", "month_number=1"))
    late = view.filter("year = 2025").withColumn("rag_status", F.lit("late"))
    export_views({"v": late}, str(tmp_path), dynamic=True)
    back = {(r.year, r.branch_id): r.rag_status for r in spark.read.parquet(paths["v"]).collect()}
    assert len(back) == 6 and {v for (y, _), v in back.items() if y == 2025} == {"late"}
    assert "late" not in {v for (y, _), v in back.items() if y == 2024}


def test_positions_of_an_ordered_export(spark, tmp_path):
    from kpilane.sources.star import read_ordered

    rows = [(2024 + i % 2, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "year int, k int, v int").repartition(7)
    paths = export_views({"v": df, "w": df}, str(tmp_path), order_by={"v": ["k"], "w": ["k"]})
    got = read_ordered(spark, paths["v"], ["year"]).collect()
    assert len(got) == 1000
    for year in (2024, 2025):
        own = sorted((r.k, r.position) for r in got if r.year == year)
        assert [p for _, p in own] == list(range(1, len(own) + 1))
    export_views({"w": df}, str(tmp_path), partition_by=None, order_by={"w": ["k"]})
    flat = sorted((r.k, r.position) for r in read_ordered(spark, paths["w"]).collect())
    assert [p for _, p in flat] == list(range(1, 1001))


def test_star_refresh_replaces_one_period(spark, golden, tmp_path):
    star, folder = _two_years(golden), str(tmp_path)
    save_star(star, folder, by_period=True)
    stored = load_star(spark, folder)
    for t in star:
        assert sorted(stored[t].collect(), key=str) == sorted(
            star[t].select(*stored[t].columns).collect(), key=str), t
    doubled = star["fact_sales"].filter("year = 2025").withColumn("lending_actual", F.col("lending_actual") * 2)
    for _ in range(2):  # a replay leaves the same rows
        replace_periods({"fact_sales": doubled}, folder)
    sums = {r.year: r.s for r in load_star(spark, folder)["fact_sales"].groupBy("year")
            .agg(F.sum("lending_actual").alias("s")).collect()}
    was = {r.year: r.s for r in star["fact_sales"].groupBy("year").agg(F.sum("lending_actual").alias("s")).collect()}
    assert sums == {2024: was[2024], 2025: 2 * was[2025]}
    with pytest.raises(ValueError):
        replace_periods({"dim_branch": star["dim_branch"]}, folder)


def test_period_filters_reach_the_folders(spark, golden, tmp_path):
    save_star(_two_years(golden), str(tmp_path), by_period=True)
    star = load_star(spark, str(tmp_path))
    for t in PERIOD_TABLES:
        plan = _plan(star[t].filter("year = 2025 and month_number = 1"))
        assert "(year#" in plan.split("PartitionFilters: ")[1].split("]")[0], t
    scores = emp.employee_monthly_score(star, period_cols=PERIOD)
    found = top_advisors(scores)
    assert found.collect() == top_advisors(emp.employee_monthly_score(_two_years(golden), period_cols=PERIOD)).collect()
    scans = [x for x in _plan(found).split("\n") if "FileScan" in x and "lending" in x]
    assert scans and all("Subquery" in x.split("PartitionFilters: ")[1] for x in scans)  # one period's folders


def test_top_advisors_starts_no_job_and_bounds_n(spark, golden):
    scores = emp.employee_monthly_score(golden)
    before = _jobs(spark)
    found = top_advisors(scores, n=2)
    assert _jobs(spark) == before
    assert found.count() == 2
    with pytest.raises(ValueError):
        top_advisors(scores, n=10**6)


def test_views_are_plans(spark, golden, tmp_path):
    star, folder = _two_years(golden), str(tmp_path)
    late = star["fact_sales"].filter("year = 2025")
    save_star(star | {"fact_sales": star["fact_sales"].filter("year = 2024")}, folder, by_period=True)
    stored = load_star(spark, folder)
    before = _jobs(spark)
    views = register_views(spark, stored)
    assert _jobs(spark) == before  # nothing ran
    assert spark.table("vw_employee_rank").filter("year = 2025").count() == 0
    replace_periods({"fact_sales": late}, folder)
    spark.catalog.refreshByPath(folder)
    register_views(spark, load_star(spark, folder))
    got = spark.table("vw_employee_rank").filter("year = 2025")
    want = emp.employee_rank(emp.employee_monthly_score(star, period_cols=PERIOD), method="window",
                             period_cols=PERIOD).filter("year = 2025")
    assert sorted(got.collect()) == sorted(want.collect()) and set(views) == set(VIEW_NAMES)
    scans = [x for x in _plan(got).split("\n") if "FileScan" in x and "lending_actual" in x]
    assert any("year#" in x.split("PartitionFilters: ")[1].split("]")[0] and "= 2025" in x for x in scans)


@pytest.mark.parametrize("ties", ["rank", "dense"])
def test_lazy_ranks_equal_the_window(golden, ties):
    star = _two_years(golden)
    views = build_views(star, ties)
    want = emp.employee_rank(emp.employee_monthly_score(star, period_cols=PERIOD), ties=ties, method="window",
                             period_cols=PERIOD)
    assert sorted(views["vw_employee_rank"].collect()) == sorted(want.collect())


def test_bound_report_takes_the_year(spark, golden):
    register_views(spark, _two_years(golden))
    top = {y: top_advisors_sql(spark, 1, year=y).collect() for y in (2024, 2025)}
    assert top[2024] != top[2025] and len(top[2025]) == 3
    with pytest.raises(ValueError):
        top_advisors_sql(spark, 1)
    register_views(spark, golden)
    assert top_advisors_sql(spark, 1).collect() == top[2025]
    with pytest.raises(ValueError):
        top_advisors_sql(spark, 1, year=2025)


def test_stored_weights_make_the_scores(spark, golden, tmp_path):
    path = str(tmp_path / "weights")
    write_csv(role_weights_frame(spark), path)
    as_stored = emp.employee_monthly_score(golden | {"dim_role_weights": read_role_weights(spark, path)})
    assert sorted(as_stored.collect()) == sorted(emp.employee_monthly_score(golden).collect())
    # 5 points go from Lending to Investing in the file
    moved = role_weights_frame(spark).withColumn("weight_pct", F.col("weight_pct") + F.when(
        F.col("metric_name") == "Lending", -5.0).when(F.col("metric_name") == "Investing", 5.0).otherwise(0.0))
    write_csv(moved, path)
    changed = emp.employee_monthly_score(golden | {"dim_role_weights": read_role_weights(spark, path)})
    assert sorted(changed.collect()) != sorted(as_stored.collect())
    scores = {r.employee_id: r.weighted_total_score for r in changed.collect()}
    want = {r.employee_id: r.weighted_total_score
            for r in emp.employee_monthly_score(golden | {"dim_role_weights": moved}).collect()}
    assert scores == want


@pytest.mark.parametrize("rows, fault", [
    ([("Advisor", "Lending", 60.0), ("Advisor", "Lending", 40.0)], "given twice"),
    ([("Advisor", "Lending", 60.0), ("Advisor", "Investing", 41.0)], "don't add up")])
def test_faulty_weights_fail_the_job(spark, tmp_path, rows, fault):
    write_csv(spark.createDataFrame(rows, "role string, metric_name string, weight_pct double"), str(tmp_path / "w"))
    with pytest.raises(Exception, match=fault):
        read_role_weights(spark, str(tmp_path / "w")).collect()


def test_branch_page_has_the_branchs_pillars(golden):
    ranked = emp.employee_rank(emp.employee_monthly_score(golden))
    branches = br.branch_rank(br.branch_pacing(br.branch_monthly_score(golden)))
    page = branch_team(ranked, branches, weights=golden["dim_role_weights"])
    rows = {r.branch_id: r for r in page.collect()}
    scores = {r.branch_id: r for r in branches.collect()}
    for b, r in rows.items():
        assert [p.pillar_name for p in r.pillars] == ["Lending", "Investing", "Banking", "LEI", "Compliance"]
        assert [p.weight_pct for p in r.pillars] == [30.0, 30.0, 15.0, 10.0, 15.0]
        assert [p.pct_to_target for p in r.pillars] == [scores[b][f"{k}_pct_to_target"] for k in (
            "lending", "investing", "banking_units", "lei", "compliance")]
        if r.branch_score is not None:
            assert abs(sum(p.pct_to_target * p.weight_pct for p in r.pillars) / 100 - r.branch_score) < 1e-12
    assert "pillars" not in branch_team(ranked, branches).columns


def test_rollup_expands_sums_not_facts(golden):
    from kpilane.operators import measures as ms

    plan = ms.measure_rollup(golden, ["province", "tier"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    expand = next(i for i, x in enumerate(plan) if "Expand" in x)
    assert any("Aggregate" in x for x in plan[expand:]) and not any("Expand" in x for x in plan[expand + 1:])
