import os
import tempfile

from pyspark.sql import functions as F

from kpilane.functions.labels import to_iso_date
from kpilane.plans.views import VIEW_NAMES, register_views, top_advisors_sql
from kpilane.sources.star import export_views


def test_register_views_and_parameterised_sql(spark, golden):
    views = register_views(spark, golden)
    assert set(views) == set(VIEW_NAMES)
    counts = {v: spark.sql(f"SELECT COUNT(*) AS n FROM {v}").collect()[0].n for v in VIEW_NAMES}
    assert counts == {"vw_employee_monthly_score": 9, "vw_employee_rank": 9, "vw_employee_scorecard_long": 31,
                      "vw_branch_monthly_score": 3, "vw_branch_pacing": 3}
    latest = spark.sql("SELECT MAX(month_number) AS m FROM vw_employee_rank WHERE role = 'Advisor'").collect()[0].m
    top = [(r.employee_id, r.rank_within_role) for r in top_advisors_sql(spark, latest).collect()]
    assert top == [(5, 1), (6, 1), (2, 3)]


def test_ordered_export(spark, golden):
    d = tempfile.mkdtemp(prefix="kpilane-export-")
    views = register_views(spark, golden)
    export_views({"vw_employee_rank": views["vw_employee_rank"]}, d, partition_by=None,
                 order_by={"vw_employee_rank": ["employee_id", "month_number"]})
    back = spark.read.parquet(os.path.join(d, "vw_employee_rank"))
    ids = [r.employee_id for r in back.collect()]
    assert ids == sorted(ids)
    part = tempfile.mkdtemp(prefix="kpilane-export-")
    export_views({"vw_employee_rank": views["vw_employee_rank"]}, part,
                 order_by={"vw_employee_rank": ["employee_id", "month_number"]})
    month = spark.read.parquet(os.path.join(part, "vw_employee_rank", "month_number=1"))
    ids = [r.employee_id for r in month.collect()]
    assert ids == sorted(ids) and len(ids) == 9


def test_hire_date(spark, golden):
    r = golden["dim_employee"].select(to_iso_date("hire_date").alias("d"),
                                      to_iso_date(F.lit("2020-13-45")).alias("bad")).first()
    assert str(r.d) == "2020-01-01" and r.bad is None
