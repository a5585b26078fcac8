import pytest

from kpilane.functions.scoring import rag_status
from kpilane.operators import branch as br
from kpilane.operators import employee as emp
from tests.golden import EXPECTED_BRANCH, EXPECTED_EMPLOYEE

TOL = 1e-12


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= TOL


@pytest.fixture(scope="module")
def scores(golden):
    return emp.employee_monthly_score(golden).cache()


def test_employee_scores(scores):
    rows = {r.employee_id: r for r in scores.collect()}
    assert set(rows) == set(EXPECTED_EMPLOYEE), "orphans 8 and 9 drop out, everyone else stays"
    for e, (pcts, score, _, _) in EXPECTED_EMPLOYEE.items():
        r = rows[e]
        got = (r.lending_pct_to_target, r.investing_pct_to_target, r.banking_units_pct_to_target,
               r.lei_pct_to_target)
        assert all(_close(a, b) for a, b in zip(got, pcts)), (e, got, pcts)
        assert _close(r.weighted_total_score, score), (e, r.weighted_total_score, score)


@pytest.mark.parametrize("method", ["range", "window"])
@pytest.mark.parametrize("ties", ["rank", "dense"])
def test_employee_ranks(scores, method, ties):
    pick = 0 if ties == "rank" else 1
    ranked = emp.employee_rank(scores, ties=ties, method=method)
    assert ranked.columns == emp.SCORE_COLUMNS + ["rank_within_role", "rank_within_branch"]
    got = {r.employee_id: (r.rank_within_role, r.rank_within_branch) for r in ranked.collect()}
    want = {e: (v[2][pick], v[3][pick]) for e, v in EXPECTED_EMPLOYEE.items()}
    assert got == want


def test_long_view(scores):
    long = emp.employee_scorecard_long(emp.employee_rank(scores))
    rows = long.collect()
    assert len(rows) == 31
    labels = {(r.employee_id, r.pillar_name) for r in rows}
    assert (3, "Lending") not in labels and (3, "Banking") in labels
    assert (10, "Lending") not in labels and (10, "Investing") in labels
    assert {r.pillar_name for r in rows} == {"Lending", "Investing", "Banking", "LEI"}


def test_long_view_matches_four_leg_union(scores):
    from functools import reduce
    from pyspark.sql import functions as F
    ranked = emp.employee_rank(scores, method="window")
    legs = []
    for key, label, guarded in [("lending", "Lending", True), ("investing", "Investing", True),
                                ("banking_units", "Banking", False), ("lei", "LEI", False)]:
        cond = F.col(f"{key}_pct_to_target").isNotNull()
        if guarded:
            cond = cond & (F.col("role") != "Teller")
        legs.append(ranked.filter(cond).select("employee_id", F.lit(label).alias("pillar_name"),
                                               F.col(f"{key}_pct_to_target").alias("pct_to_target")))
    union = reduce(lambda a, b: a.unionByName(b), legs)
    long = emp.employee_scorecard_long(ranked).select("employee_id", "pillar_name", "pct_to_target")
    assert sorted(union.collect()) == sorted(long.collect())


def test_normalized_scores(golden):
    rows = {r.employee_id: r.weighted_total_score
            for r in emp.employee_monthly_score(golden, normalize="applicable").collect()}
    assert _close(rows[1], 84 / 85)
    assert _close(rows[4], 1.0)
    assert _close(rows[10], 1.0)
    assert rows[7] is None


def test_branch_scores_band_and_rank(golden):
    pacing = br.branch_pacing(br.branch_monthly_score(golden))
    for method in ("range", "window"):
        rows = {r.branch_id: r for r in br.branch_rank(pacing, method=method).collect()}
        assert set(rows) == set(EXPECTED_BRANCH)
        for b, (pcts, score, band, rank) in EXPECTED_BRANCH.items():
            r = rows[b]
            got = (r.lending_pct_to_target, r.investing_pct_to_target, r.banking_units_pct_to_target,
                   r.lei_pct_to_target, r.compliance_pct_to_target)
            assert all(_close(a, x) for a, x in zip(got, pcts)), (b, got)
            assert _close(r.weighted_total_score, score)
            assert r.rag_status == band
            assert r.branch_rank == rank


def test_rag_band_edges(spark):
    df = spark.createDataFrame([(1.0,), (0.9,), (0.8999999,), (None,), (1.5,)], "s double")
    got = [r.b for r in df.select(rag_status("s").alias("b")).collect()]
    assert got == ["Green", "Amber", "Red", "Red", "Green"]


def test_manager_weights_one_row_even_without_managers(spark):
    from kpilane.operators.weights import manager_weights
    w = spark.createDataFrame([("Teller", "Banking units", 70.0)], "role string, metric_name string, weight_pct double")
    rows = manager_weights(w).collect()
    assert len(rows) == 1 and all(v is None for v in rows[0])


def test_pivot_takes_max_of_duplicates(spark):
    from kpilane.operators.weights import role_weights_pivot
    w = spark.createDataFrame([("Advisor", "Lending", 35.0), ("Advisor", "Lending", 40.0)],
                              "role string, metric_name string, weight_pct double")
    r = role_weights_pivot(w).collect()[0]
    assert r.lending_weight == 40.0 and r.investing_weight is None
