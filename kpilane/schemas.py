"""Table schemas, the pillar registry and the fixed configuration values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STAR_TABLES = (
    "dim_branch",
    "dim_employee",
    "dim_role_weights",
    "fact_sales",
    "fact_targets",
    "fact_lei_survey",
    "fact_compliance",
)


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "string": T.StringType()}


def _schema(spec: str) -> T.StructType:
    """``"name type, name type"`` with the four column types the star uses (nullable)."""
    fields = []
    for item in spec.split(","):
        name, type_name = item.split()
        fields.append(T.StructField(name, _TYPES[type_name], True))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "dim_branch": _schema(
        "branch_id bigint, branch_code string, branch_name string, tier string, province string, "
        "city string, manager_count int, advisor_count int, teller_count int, employee_count int, "
        "opening_year int"
    ),
    "dim_employee": _schema(
        "employee_id bigint, branch_id bigint, branch_code string, tier string, province string, "
        "city string, role string, first_name string, last_name string, hire_date string"
    ),
    "dim_role_weights": _schema("role string, metric_name string, weight_pct double"),
    "fact_compliance": _schema(
        "branch_id bigint, branch_code string, month_number int, month_name string, tier string, "
        "province string, city string, compliance_score double, risk_score double, "
        "exceptions_count int"
    ),
    "fact_lei_survey": _schema(
        "employee_id bigint, branch_id bigint, month_number int, month_name string, "
        "survey_response_count int, lei_score double"
    ),
    "fact_sales": _schema(
        "employee_id bigint, branch_id bigint, branch_code string, role string, tier string, "
        "month_number int, month_name string, lending_actual double, investing_actual double, "
        "banking_units_actual double, lei_actual double"
    ),
    "fact_targets": _schema(
        "employee_id bigint, branch_id bigint, branch_code string, role string, tier string, "
        "month_number int, month_name string, target_lending double, target_investing double, "
        "target_banking_units double, target_lei double, target_compliance double"
    ),
}

@dataclass(frozen=True)
class Pillar:
    key: str             # column stem: <key>_pct_to_target, <key>_weight
    long_label: str      # pillar_name in the long scorecard view
    weight_metric: str   # metric_name in dim_role_weights
    actual: str          # actual column (fact_sales, or fact_compliance for compliance)
    target: str          # target column in fact_targets
    teller_excluded: bool


# --- fixed values (must equal the scorecard definition) ---------------------
# Pillars in the order their terms are added up in the weighted score.
PILLARS: tuple[Pillar, ...] = (
    Pillar("lending", "Lending", "Lending", "lending_actual", "target_lending", True),
    Pillar("investing", "Investing", "Investing", "investing_actual", "target_investing", True),
    Pillar("banking_units", "Banking", "Banking units", "banking_units_actual", "target_banking_units", False),
    Pillar("lei", "LEI", "LEI customer score", "lei_actual", "target_lei", False),
    Pillar("compliance", "Compliance", "Compliance / Risk", "compliance_score", "target_compliance", False),
)
EMPLOYEE_PILLARS = PILLARS[:4]   # the employee score has no compliance term
BRANCH_PILLARS = PILLARS         # the branch score uses all five, Manager weights

# Role x pillar weights (percent). Rows exist only where a pillar applies.
ROLE_WEIGHTS: tuple[tuple[str, str, float], ...] = (
    ("Advisor", "Lending", 35.0),
    ("Advisor", "Investing", 35.0),
    ("Advisor", "Banking units", 15.0),
    ("Advisor", "LEI customer score", 15.0),
    ("Teller", "Banking units", 70.0),
    ("Teller", "LEI customer score", 30.0),
    ("Manager", "Lending", 30.0),
    ("Manager", "Investing", 30.0),
    ("Manager", "Banking units", 15.0),
    ("Manager", "LEI customer score", 10.0),
    ("Manager", "Compliance / Risk", 15.0),
)

# RAG thresholds, compared against the unrounded score.
GREEN_AT = 1.0
AMBER_AT = 0.9

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Base monthly targets per tier and role: lending, investing, banking, compliance
# (None = pillar not targeted for that role; counts as 0 in a plan).
BASE_TARGETS: tuple[tuple[str, str, float | None, float | None, float | None, float | None], ...] = (
    ("Small", "Advisor", 1800.0, 1400.0, 420.0, None),
    ("Small", "Teller", None, None, 560.0, None),
    ("Small", "Manager", 2500.0, 1800.0, 600.0, 88.0),
    ("Medium", "Advisor", 2400.0, 1800.0, 560.0, None),
    ("Medium", "Teller", None, None, 740.0, None),
    ("Medium", "Manager", 3200.0, 2300.0, 740.0, 90.0),
    ("Large", "Advisor", 3200.0, 2400.0, 740.0, None),
    ("Large", "Teller", None, None, 920.0, None),
    ("Large", "Manager", 4200.0, 3000.0, 920.0, 92.0),
)
TARGET_LEI = 4.0
SEASONAL_AMPLITUDE = 0.06

# Legal scales of the bounded scores.
SCORE_BOUNDS = {
    "lei_score": (1.0, 5.0),
    "compliance_score": (80.0, 100.0),
    "risk_score": (0.0, 25.0),
}
# --- end of fixed values ----------------------------------------------------

BASE_TARGETS_SCHEMA = _schema(
    "tier string, role string, base_lending double, base_investing double, "
    "base_banking_units double, base_compliance double"
)

# Columns a CSV extract types as integers (truncating ``int(float(v))``); other numbers are reals.
INTEGER_COLUMNS = frozenset(f.name for schema in SCHEMAS.values() for f in schema.fields
                            if f.dataType.typeName() in ("integer", "long")) | {"year"}

# The facts that are kept by period.
PERIOD_TABLES = tuple(t for t in STAR_TABLES if "month_number" in SCHEMAS[t].fieldNames())

# Months of several years carry a year before the month number.
PERIOD_COLUMNS = ("year", "month_number")


def period_columns(df: DataFrame) -> list[str]:
    """The period keys ``df`` carries: ``month_number``, after ``year`` where there is one."""
    return [c for c in PERIOD_COLUMNS if c in df.columns]


def table_schema(table: str, columns) -> T.StructType:
    """The table's schema; with ``year`` before ``month_number`` where ``columns`` hold one."""
    fields = list(SCHEMAS[table].fields)
    names = SCHEMAS[table].fieldNames()
    if "year" in columns and "month_number" in names:
        fields.insert(names.index("month_number"), T.StructField("year", T.IntegerType(), True))
    return T.StructType(fields)
