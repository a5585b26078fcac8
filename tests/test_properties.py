"""Property tests over random facts for the golden employees."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpilane.functions.scoring import rag_status
from kpilane.operators import employee as emp
from kpilane.plans.reports import pillar_detail
from kpilane.schemas import SCHEMAS
from tests.golden import EMPLOYEES

VALUE = st.sampled_from([0.0, 1.0, 2.5, 10.0, 100.0, 333.33])
FACT = st.tuples(VALUE, VALUE, VALUE, VALUE, VALUE, VALUE, VALUE, VALUE)


@settings(max_examples=5, deadline=None)
@given(facts=st.lists(FACT, min_size=len(EMPLOYEES), max_size=len(EMPLOYEES)))
def test_long_view_and_contributions(spark, golden, facts):
    sales, targets = [], []
    for (e, (b, role)), f in zip(sorted(EMPLOYEES.items()), facts):
        sales.append((e, b, None, role, None, 1, "January", *f[:4]))
        targets.append((e, b, None, role, None, 1, "January", *f[4:], 0.0))
    star = dict(golden)
    star["fact_sales"] = spark.createDataFrame(sales, SCHEMAS["fact_sales"])
    star["fact_targets"] = spark.createDataFrame(targets, SCHEMAS["fact_targets"])
    scores = emp.employee_monthly_score(star)
    rows = {r.employee_id: r for r in scores.collect()}
    long = emp.employee_scorecard_long(scores)

    expected = 0
    for r in rows.values():
        pcts = [r.lending_pct_to_target, r.investing_pct_to_target, r.banking_units_pct_to_target,
                r.lei_pct_to_target]
        expected += sum(p is not None for p in pcts)
    assert long.count() == expected

    detail = pillar_detail(long, star["dim_role_weights"])
    sums = {r.employee_id: r.s for r in detail.groupBy("employee_id").agg(F.sum("contribution").alias("s")).collect()}
    for e, r in rows.items():
        assert abs(sums.get(e, 0.0) - r.weighted_total_score) < 1e-9, (e, sums.get(e), r.weighted_total_score)


@settings(max_examples=5, deadline=None)
@given(scores=st.lists(st.floats(min_value=0, max_value=2, allow_nan=False), min_size=2, max_size=30))
def test_rag_is_monotone(spark, scores):
    order = {"Red": 0, "Amber": 1, "Green": 2}
    df = spark.createDataFrame([(s,) for s in sorted(scores)], "s double")
    bands = [order[r.b] for r in df.select(rag_status("s").alias("b")).collect()]
    assert bands == sorted(bands)


@settings(max_examples=4, deadline=None)
@given(facts=st.lists(FACT, min_size=len(EMPLOYEES), max_size=len(EMPLOYEES)),
       compliance=st.lists(VALUE, min_size=3, max_size=3))
def test_measure_at_branch_grain_equals_branch_view(spark, golden, facts, compliance):
    from kpilane.operators import branch as br
    from kpilane.operators import measures as ms
    sales, targets = [], []
    for (e, (b, role)), f in zip(sorted(EMPLOYEES.items()), facts):
        sales.append((e, b, None, role, None, 1, "January", *f[:4]))
        targets.append((e, b, None, role, None, 1, "January", *f[4:], 10.0 if role == "Manager" else 0.0))
    star = dict(golden)
    star["fact_sales"] = spark.createDataFrame(sales, SCHEMAS["fact_sales"])
    star["fact_targets"] = spark.createDataFrame(targets, SCHEMAS["fact_targets"])
    star["fact_compliance"] = spark.createDataFrame(
        [(b, None, 1, "January", None, None, None, c, 100.0 - c, 0) for b, c in zip((1, 2, 3), compliance)],
        SCHEMAS["fact_compliance"])
    keys = ["branch_id", "month_number"]
    m = {r.branch_id: r for r in ms.measure_by_grain(star, keys).collect()}
    v = {r.branch_id: r for r in br.branch_monthly_score(star).collect()}
    assert set(m) == set(v)
    for b in v:
        for c in ms.MEASURE_COLUMNS:
            assert m[b][c] == v[b][c], (b, c, m[b][c], v[b][c])
