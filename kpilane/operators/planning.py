"""Deterministic planning jobs: target plans, calendar, labels, fact enrichment, clamps."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpilane.functions.labels import branch_code, branch_name, month_factor, month_name
from kpilane.functions.scoring import clamp, out_of_range
from kpilane.schemas import BASE_TARGETS, BASE_TARGETS_SCHEMA, SCORE_BOUNDS, TARGET_LEI, period_columns


def base_targets_frame(spark: SparkSession) -> DataFrame:
    """Base monthly targets per tier and role (configuration rows)."""
    return spark.createDataFrame(list(BASE_TARGETS), BASE_TARGETS_SCHEMA)


def target_plan(employees: DataFrame, base_targets: DataFrame, months: int = 12) -> DataFrame:
    """Monthly targets per employee: tier x role base x seasonal factor, rounded to cents.

    A pillar without a base for the role plans 0; the customer-score target is
    constant.  Each employee row is expanded to ``months`` rows in place
    (``explode(sequence)``), so the plan is as parallel as the employee table.
    """
    base = base_targets
    e = employees.select("employee_id", "branch_id", "branch_code", "role", "tier")
    rows = (e.join(base, ["tier", "role"], "left")
            .withColumn("month_number", F.explode(F.sequence(F.lit(1), F.lit(months)))))
    factor = month_factor("month_number")

    def planned(col: str):
        return F.round(F.coalesce(F.col(col), F.lit(0.0)) * factor, 2)

    return rows.select(
        "employee_id", "branch_id", "branch_code", "role", "tier", "month_number",
        month_name("month_number").alias("month_name"),
        planned("base_lending").alias("target_lending"),
        planned("base_investing").alias("target_investing"),
        planned("base_banking_units").alias("target_banking_units"),
        F.lit(TARGET_LEI).alias("target_lei"),
        planned("base_compliance").alias("target_compliance"))


def month_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar rows for every (year, month) present in ``date_col``."""
    d = df.select(F.year(date_col).alias("year"), F.month(date_col).alias("month_number")).filter(
        F.col("year").isNotNull()).groupBy("year", "month_number").agg(F.count(F.lit(1)).alias("source_rows"))
    first = F.make_date("year", "month_number", F.lit(1))
    return d.select(
        "year", "month_number", month_name("month_number").alias("month_name"),
        F.quarter(first).alias("quarter"),
        F.dayofmonth(F.last_day(first)).alias("days_in_month"),
        F.date_format(first, "yyyy-MM-dd").alias("first_day"),
        F.round(month_factor("month_number"), 6).alias("seasonal_factor"),
        "source_rows")


def branch_labels(branches: DataFrame) -> DataFrame:
    """branch_id, tier, branch_code (e.g. SMA001) and branch_name (e.g. Small Branch 001)."""
    return branches.select("branch_id", "tier",
                           branch_code("tier", "branch_id").alias("branch_code"),
                           branch_name("tier", "branch_id").alias("branch_name"))


def enrich_facts(facts: DataFrame, employees: DataFrame, guarded_role: str = "Teller") -> DataFrame:
    """Sales facts with the employee's branch, role and tier from the dimension.

    Lending and investing are 0 for ``guarded_role``; a fact whose employee is
    missing keeps NULL attributes and ``employee_found = false`` (the lookup
    would fail there).
    """
    e = employees.select("employee_id", F.col("branch_id").alias("emp_branch_id"),
                         F.col("branch_code").alias("emp_branch_code"), F.col("role").alias("emp_role"),
                         F.col("tier").alias("emp_tier"), F.lit(True).alias("_found"))
    period = period_columns(facts)
    j = facts.select("employee_id", *period, "month_name", "lending_actual", "investing_actual",
                     "banking_units_actual", "lei_actual").join(e, "employee_id", "left")
    guarded = F.col("emp_role") == F.lit(guarded_role)

    def measured(col: str):
        return F.when(guarded, F.lit(0.0)).otherwise(F.col(col))

    return j.select(
        "employee_id", F.col("emp_branch_id").alias("branch_id"), F.col("emp_branch_code").alias("branch_code"),
        F.col("emp_role").alias("role"), F.col("emp_tier").alias("tier"), *period, "month_name",
        measured("lending_actual").alias("lending_actual"),
        measured("investing_actual").alias("investing_actual"),
        "banking_units_actual", "lei_actual",
        F.coalesce(F.col("_found"), F.lit(False)).alias("employee_found"))


def clamp_scores(compliance: DataFrame) -> DataFrame:
    """Bound compliance to its legal scale, derive risk as its clamped complement.

    Returns branch_id, the period, compliance_score, compliance_clamped,
    compliance_out_of_range, risk_score, risk_from_compliance, risk_out_of_range.
    """
    clo, chi = SCORE_BOUNDS["compliance_score"]
    rlo, rhi = SCORE_BOUNDS["risk_score"]
    comp = clamp("compliance_score", clo, chi)
    return compliance.select(
        "branch_id", *period_columns(compliance), "compliance_score",
        comp.alias("compliance_clamped"),
        out_of_range("compliance_score", clo, chi).alias("compliance_out_of_range"),
        "risk_score",
        clamp(F.lit(100.0) - comp, rlo, rhi).alias("risk_from_compliance"),
        out_of_range("risk_score", rlo, rhi).alias("risk_out_of_range"))


def clamp_survey(survey: DataFrame) -> DataFrame:
    lo, hi = SCORE_BOUNDS["lei_score"]
    return survey.select("employee_id", *period_columns(survey), "lei_score",
                         clamp("lei_score", lo, hi).alias("lei_clamped"),
                         out_of_range("lei_score", lo, hi).alias("lei_out_of_range"))
