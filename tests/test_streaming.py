import os
import tempfile

from pyspark.sql import functions as F

from kpilane.operators import employee as emp
from kpilane.sources.star import save_star
from kpilane.streaming import start_monthly_refresh


def test_stream_refreshes_only_new_months(spark, golden):
    root = tempfile.mkdtemp(prefix="kpilane-stream-")
    star_dir, out_dir = os.path.join(root, "star"), os.path.join(root, "views")
    save_star(golden, star_dir)
    q = start_monthly_refresh(spark, star_dir, out_dir, os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out_dir, "vw_employee_rank"))
    want = emp.employee_rank(emp.employee_monthly_score(golden))
    cols = ["employee_id", "month_number", "weighted_total_score", "rank_within_role", "rank_within_branch"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())

    # a second month lands: month 1 stays, month 2 is added
    m2 = golden["fact_sales"].withColumn("month_number", F.lit(2)).withColumn("month_name", F.lit("February"))
    m2.write.mode("append").parquet(os.path.join(star_dir, "fact_sales"))
    golden["fact_targets"].withColumn("month_number", F.lit(2)).write.mode("append").parquet(
        os.path.join(star_dir, "fact_targets"))
    golden["fact_compliance"].withColumn("month_number", F.lit(2)).write.mode("append").parquet(
        os.path.join(star_dir, "fact_compliance"))
    q = start_monthly_refresh(spark, star_dir, out_dir, os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    months = sorted(r.month_number for r in spark.read.parquet(os.path.join(out_dir, "vw_employee_rank"))
                    .select("month_number").distinct().collect())
    assert months == [1, 2]
    assert spark.read.parquet(os.path.join(out_dir, "vw_branch_pacing")).filter("month_number = 2").count() == 3
