import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kpilane.functions.labels import branch_code, month_name
from kpilane.functions.scoring import clamp, safe_divide
from kpilane.operators import planning as pl
from kpilane.sources.star import export_views, load_star, read_csv_typed, save_star


def _tmp():
    return tempfile.mkdtemp(prefix="kpilane-test-")


def test_csv_typing(spark):
    d = _tmp()
    path = os.path.join(d, "fact_lei_survey.csv")
    with open(path, "w", newline="") as fh:
        fh.write("employee_id,branch_id,month_number,month_name,survey_response_count,lei_score\r\n")
        fh.write("3.7,1,1,,12,\r\n")
        fh.write("-3.7,2,2,February,4,12\r\n")
    rows = read_csv_typed(spark, path, "fact_lei_survey").collect()
    assert rows[0].employee_id == 3 and rows[1].employee_id == -3
    assert rows[0].lei_score is None and rows[1].lei_score == 12.0
    assert rows[0].month_name == ""


def test_csv_malformed_number_fails(spark):
    d = _tmp()
    path = os.path.join(d, "w.csv")
    with open(path, "w") as fh:
        fh.write("role,metric_name,weight_pct\nAdvisor,Lending,abc\n")
    with pytest.raises(Exception):
        read_csv_typed(spark, path, "dim_role_weights").collect()


def test_star_roundtrip_overwrite_and_export(spark, golden):
    d = _tmp()
    save_star(golden, d)
    save_star(golden, d)  # replace, not append
    back = load_star(spark, d)
    assert back["fact_sales"].count() == golden["fact_sales"].count()
    save_star(golden, os.path.join(d, "csv"), fmt="csv")
    csv_back = load_star(spark, os.path.join(d, "csv"), fmt="csv")
    # a NULL text cell comes back as '' (blank text stays text); numbers round-trip exactly
    want = golden["fact_targets"].fillna("", subset=["branch_code", "role"])
    assert sorted(csv_back["fact_targets"].collect()) == sorted(want.collect())
    paths = export_views({"sales": golden["fact_sales"]}, os.path.join(d, "export"))
    assert os.path.isdir(os.path.join(paths["sales"], "month_number=1"))


def test_empty_source_gives_empty_table(spark):
    d = _tmp()
    path = os.path.join(d, "w.csv")
    with open(path, "w") as fh:
        fh.write("role,metric_name,weight_pct\n")
    assert read_csv_typed(spark, path, "dim_role_weights").count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([("Small", 1, 5.0, 0.0, 6.5), ("Large", 1234, None, 2.0, None)],
                               "tier string, id long, a double, b double, x double")
    r = df.select(branch_code("tier", "id").alias("c"), safe_divide("a", "b").alias("q"),
                  clamp("x", 1.0, 5.0).alias("k"), month_name(F.lit(12)).alias("m")).collect()
    assert [x.c for x in r] == ["SMA001", "LAR1234"]
    assert [x.q for x in r] == [None, None]
    assert [x.k for x in r] == [5.0, None]
    assert r[0].m == "December"


def test_target_plan(spark, golden):
    plan = pl.target_plan(golden["dim_employee"], pl.base_targets_frame(spark))
    assert plan.count() == 9 * 12
    r = plan.filter("employee_id = 1 and month_number = 1").collect()[0]
    assert (r.target_lending, r.target_investing, r.target_banking_units, r.target_compliance) == \
        (2500.0, 1800.0, 600.0, 88.0)
    intern = plan.filter("employee_id = 7 and month_number = 4").collect()[0]
    assert intern.target_lending == 0.0
    apr = plan.filter("employee_id = 2 and month_number = 4").collect()[0]
    assert apr.target_lending == round(1800 * 1.06, 2)


def test_enrich_and_clamp(golden):
    e = {r.employee_id: r for r in pl.enrich_facts(golden["fact_sales"], golden["dim_employee"]).collect()}
    assert e[3].lending_actual == 0.0 and e[8].employee_found is False and e[1].role == "Manager"
    c = {r.branch_id: r for r in pl.clamp_scores(golden["fact_compliance"]).collect()}
    assert c[2].compliance_out_of_range is False and c[2].risk_from_compliance == 19.0


def test_csv_text_round_trips_as_written(spark, tmp_path):
    from kpilane.sources.star import read_csv_typed, write_csv

    rows = [('A "x", b', "two\nlines", 1.5), ("  pad ", "", None)]
    path = str(tmp_path / "weights")
    write_csv(spark.createDataFrame(rows, "role string, metric_name string, weight_pct double"), path)
    back = read_csv_typed(spark, path, "dim_role_weights")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_csv_cells_go_to_columns_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("role,metric_name,weight_pct\nr,m,1\n")
    (tmp_path / "b.csv").write_text('\ufeffmetric_name,"weight_pct",role\r\nn,2,"s, ""x"""\r\n')
    rows = read_csv_typed(spark, str(tmp_path), "dim_role_weights").collect()
    assert sorted(map(tuple, rows)) == [("r", "m", 1.0), ('s, "x"', "n", 2.0)]


def test_csv_file_with_another_column_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("role,metric_name,weight_pct\nr,m,1\n")
    (tmp_path / "b.csv").write_text("role,metric,weight_pct\nr,m,1\n")
    with pytest.raises(Exception, match="other columns"):
        read_csv_typed(spark, str(tmp_path), "dim_role_weights").collect()


def test_large_csv_is_read_in_splits_unless_a_cell_has_line_breaks(spark, tmp_path):
    head = "employee_id,branch_id,month_number,month_name,survey_response_count,lei_score\n"
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    body = "".join(f"{i},1,1,January,2,3.5\n" for i in range(4000))
    plain.write_text(head + body)
    broken.write_text(head + body + '4000,1,1,"Jan\nuary",2,3.5\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_csv_typed(spark, str(plain), "fact_lei_survey")
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == rows.distinct().count() == 4000
        whole = read_csv_typed(spark, str(broken), "fact_lei_survey")
        assert whole.rdd.getNumPartitions() == 1 and whole.count() == 4001
        assert whole.filter("employee_id = 4000").collect()[0].month_name == "Jan\nuary"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
