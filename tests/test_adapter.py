"""The driver-table adapter on a hand-made TPC-H-shaped fixture."""

import datetime as dt
import os
import tempfile

import pytest

from kpilane.sources.adapter import star_coverage, star_from_tpch


@pytest.fixture(scope="module")
def tpch_dir(spark):
    d = tempfile.mkdtemp(prefix="kpilane-tpch-")
    ts = dt.datetime
    tables = {
        "region": ([(0, "AFRICA"), (1, "AMERICA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1), (5, "N5", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(10, "S10", 0), (12, "S12", 0), (13, "S13", 0), (20, "S20", 1)],
                     "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(1, 0), (2, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, "F", ts(1998, 3, 5)), (1, "P", ts(1998, 3, 9)), (1, "O", ts(1998, 3, 20)),
                    (2, "F", ts(1998, 4, 1)), (1, "P", ts(1997, 3, 1))],
                   "o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": ([(12, 2.0, 100.10, "A", "F", ts(1998, 1, 3)),
                      (12, 3.0, 50.05, "N", "O", ts(1998, 1, 9)),
                      (12, 1.0, 10.00, "R", "O", ts(1998, 1, 30)),
                      (12, 4.0, 200.00, "A", "F", ts(1997, 1, 2)),
                      (13, 1.0, 5.00, "A", "O", ts(1998, 2, 2)),
                      (10, 1.0, 1.00, "N", "F", ts(1996, 5, 5))],
                     "l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, "
                     "l_linestatus string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(d, f"{name}.parquet"))
    return d


def test_dimensions(spark, tpch_dir):
    star = star_from_tpch(spark, tpch_dir)
    emp = {r.employee_id: r for r in star["dim_employee"].collect()}
    assert {k: r.role for k, r in emp.items()} == {10: "Manager", 12: "Advisor", 13: "Teller", 20: "Manager"}
    assert emp[12].branch_code == "SMA000" and emp[20].tier == "Medium" and emp[12].province == "AFRICA"
    assert emp[12].hire_date == "2017-01-13"
    br = {r.branch_id: r for r in star["dim_branch"].collect()}
    assert br[5].branch_name == "Large Branch 005" and br[5].employee_count == 0
    assert (br[0].manager_count, br[0].advisor_count, br[0].teller_count, br[0].employee_count) == (1, 1, 1, 3)


def test_facts(spark, tpch_dir):
    star = star_from_tpch(spark, tpch_dir)
    sales = {(r.employee_id, r.year, r.month_number): r for r in star["fact_sales"].collect()}
    assert set(sales) == {(12, 1997, 1), (12, 1998, 1), (13, 1998, 2), (10, 1996, 5)}
    s = sales[(12, 1998, 1)]
    assert (s.lending_actual, s.investing_actual, s.banking_units_actual) == (100.10, 50.05, 6.0)
    # 1 of 3 lines closed: 1 + 4/3 cut to 4 decimals as an exact integer share
    assert s.lei_actual == 23333 / 10000
    assert s.role == "Advisor" and s.month_name == "January"
    targets = {(r.employee_id, r.year, r.month_number): r for r in star["fact_targets"].collect()}
    # the same month a year earlier
    assert set(targets) == {(12, 1998, 1), (12, 1999, 1), (13, 1999, 2), (10, 1997, 5)}
    t = targets[(12, 1998, 1)]
    assert (t.target_lending, t.target_lei, t.target_compliance) == (200.0, 4.0, 0.0)
    comp = {(r.branch_id, r.year, r.month_number): r for r in star["fact_compliance"].collect()}
    c = comp[(0, 1998, 3)]
    assert (c.compliance_score, c.risk_score, c.exceptions_count) == (66.6666, 33.3334, 1)
    assert comp[(1, 1998, 4)].compliance_score == 100.0 and comp[(0, 1997, 3)].exceptions_count == 1 and len(comp) == 3
    survey = {(r.employee_id, r.year, r.month_number): r.survey_response_count for r in star["fact_lei_survey"].collect()}
    assert survey == {(12, 1997, 1): 1, (12, 1998, 1): 3, (13, 1998, 2): 1, (10, 1996, 5): 1}
    covered = {r.source_table: r for r in star_coverage(spark, tpch_dir, star).collect()}
    assert covered["lineitem"].star_rows == covered["lineitem"].table_rows == 6
    assert covered["orders"].star_rows == 5 and all(r.covered for r in covered.values())


def test_staged_star_equals_lazy_star(spark, tpch_dir):
    lazy = star_from_tpch(spark, tpch_dir)
    staged = star_from_tpch(spark, tpch_dir, stage_dir=tempfile.mkdtemp(prefix="kpilane-stage-"))
    for t in ("fact_sales", "fact_targets", "fact_lei_survey"):
        assert sorted(lazy[t].collect()) == sorted(staged[t].collect())
