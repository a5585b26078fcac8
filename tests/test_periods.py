"""Several years of monthly data: period keys keep years apart."""

from pyspark.sql import functions as F

from kpilane.operators import branch as br
from kpilane.operators import employee as emp
from tests.golden import EXPECTED_BRANCH, EXPECTED_EMPLOYEE

PERIOD = ("year", "month_number")


def _two_years(golden):
    star = dict(golden)
    for t, cols in [("fact_sales", ["lending_actual", "investing_actual", "banking_units_actual", "lei_actual"]),
                    ("fact_targets", []), ("fact_compliance", []), ("fact_lei_survey", [])]:
        df = golden[t]
        y25 = df.withColumn("year", F.lit(2025))
        # 2024: half the actuals against the same targets
        y24 = df.select(*[(F.col(c) / 2).alias(c) if c in cols else F.col(c) for c in df.columns]) \
            .withColumn("year", F.lit(2024))
        star[t] = y25.unionByName(y24)
    return star


def test_without_year_the_join_fans_out(golden):
    star = _two_years(golden)
    assert emp.employee_monthly_score(star).count() == 4 * len(EXPECTED_EMPLOYEE)


def test_period_cols_keep_years_apart(golden):
    star = _two_years(golden)
    scores = emp.employee_monthly_score(star, period_cols=PERIOD)
    assert scores.columns[6:9] == ["year", "month_number", "month_name"]
    ranked = emp.employee_rank(scores, period_cols=PERIOD)
    rows = {(r.employee_id, r.year): r for r in ranked.collect()}
    assert len(rows) == 2 * len(EXPECTED_EMPLOYEE)
    for e, (_, score, role_rank, branch_rank) in EXPECTED_EMPLOYEE.items():
        r = rows[(e, 2025)]
        assert abs(r.weighted_total_score - score) < 1e-12
        assert (r.rank_within_role, r.rank_within_branch) == (role_rank[0], branch_rank[0])
    assert rows[(4, 2024)].weighted_total_score < rows[(4, 2025)].weighted_total_score
    long = emp.employee_scorecard_long(ranked)
    assert "year" in long.columns and long.filter("year = 2025").count() == 31

    branch = br.branch_rank(br.branch_pacing(br.branch_monthly_score(star, period_cols=PERIOD)))
    b = {(r.branch_id, r.year): r for r in branch.collect()}
    assert len(b) == 6
    for bid, (_, score, band, rank) in EXPECTED_BRANCH.items():
        r = b[(bid, 2025)]
        assert r.rag_status == band and r.branch_rank == rank
        assert (score is None and r.weighted_total_score is None) or abs(r.weighted_total_score - score) < 1e-12


def test_refresh_partitions_by_year_and_month(spark, golden):
    import os
    import tempfile

    from kpilane.streaming import refresh_months
    star = _two_years(golden)
    out = tempfile.mkdtemp(prefix="kpilane-refresh-")
    refresh_months(star, star["fact_sales"].filter("year = 2025"), out, period_cols=PERIOD)
    refresh_months(star, star["fact_sales"].filter("year = 2024"), out, period_cols=PERIOD)
    refresh_months(star, star["fact_sales"].filter("year = 2025"), out, period_cols=PERIOD)  # replay
    parts = sorted(p for p in os.listdir(os.path.join(out, "vw_employee_rank")) if p.startswith("year="))
    assert parts == ["year=2024", "year=2025"]
    got = spark.read.parquet(os.path.join(out, "vw_employee_rank"))
    assert got.count() == 2 * len(EXPECTED_EMPLOYEE)
    assert spark.read.parquet(os.path.join(out, "vw_branch_pacing")).count() == 6


def test_stream_of_two_years_keeps_them_apart(spark, golden):
    import os
    import tempfile

    from kpilane.schemas import SCHEMAS
    from kpilane.sources.star import load_star, save_star
    from kpilane.streaming import start_monthly_refresh
    root = tempfile.mkdtemp(prefix="kpilane-years-")
    star_dir, out = os.path.join(root, "star"), os.path.join(root, "views")
    star = _two_years(golden)
    save_star(star, star_dir)
    assert "year" in load_star(spark, star_dir)["fact_targets"].columns
    start_monthly_refresh(spark, star_dir, out, os.path.join(root, "ckpt"), period_cols=PERIOD).awaitTermination(300)
    assert "year" not in SCHEMAS["fact_sales"].fieldNames()
    cols = ["employee_id", *PERIOD, "weighted_total_score", "rank_within_role", "rank_within_branch"]
    want = emp.employee_rank(emp.employee_monthly_score(star, period_cols=PERIOD), period_cols=PERIOD)
    got = spark.read.parquet(os.path.join(out, "vw_employee_rank"))
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_latest_period_is_a_year_and_month(spark, golden):
    from kpilane.plans.reports import top_advisors
    star = _two_years(golden)
    both = emp.employee_monthly_score(star, period_cols=PERIOD)
    assert top_advisors(both).collect() == top_advisors(both.filter("year = 2025")).collect()
