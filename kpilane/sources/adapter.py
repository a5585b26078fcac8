"""Derive the scorecard star from the TPC-H style driver tables.

| star table        | derived from                                                        |
|-------------------|---------------------------------------------------------------------|
| dim_branch        | nation (branch) + region (province); tier by key mod 3; headcounts  |
|                   | counted from dim_employee; opening year 2008 + key mod 17           |
| dim_employee      | supplier (employee) in its nation (branch); the lowest key of each  |
|                   | nation is the Manager, other even keys Advisors, odd keys Tellers   |
| dim_role_weights  | the fixed role x pillar weights                                     |
| fact_sales        | lineitem per supplier, ship year and month: lending = price of      |
|                   | flag 'A' lines, investing = flag 'N', banking units = quantity,     |
|                   | customer score = 1 + 4 x share of status 'F' lines (4 decimals)     |
| fact_targets      | the same supplier's measures of the same month a year earlier;      |
|                   | customer-score target 4.0; compliance target 60/65/70 by tier on    |
|                   | the Manager's row                                                   |
| fact_compliance   | orders of the nation's customers per order year and month:          |
|                   | compliance = 100 x share not 'P', risk = 100 - compliance,          |
|                   | exceptions = count of 'P'                                           |
| fact_lei_survey   | as fact_sales: response count = lines, score = customer score       |

Money and quantities are summed as DECIMAL(18,2) and ratios are integer
arithmetic, so every value is reproducible bit for bit by any SQL engine and
independent of partitioning.  Every dated line and order counts: the facts hold
all years of the tables and carry ``year`` beside ``month_number``.  Rows without
a date belong to no period and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpilane.functions.labels import branch_code, branch_name, iso_date, month_name
from kpilane.sources.star import role_weights_frame

# --- fixed values of the mapping ---------------------------------------------
TIER_BY_KEY_MOD3 = ("Small", "Medium", "Large")
COMPLIANCE_TARGET_BY_TIER = {"Small": 60.0, "Medium": 65.0, "Large": 70.0}
LENDING_FLAG = "A"
INVESTING_FLAG = "N"
CLOSED_LINE_STATUS = "F"
EXCEPTION_ORDER_STATUS = "P"
# -----------------------------------------------------------------------------
MONEY = "decimal(18,2)"

_TPCH_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "orders": ["o_custkey", "o_orderstatus", "o_orderdate"],
    "lineitem": ["l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
}


def read_tpch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver tables this adapter needs, pruned to the columns it uses."""
    return {name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)
            for name, cols in _TPCH_COLUMNS.items()}


def _scaled_share(part: str, whole: str, scale: int) -> Column:
    """floor(scale * part / whole) as an exact integer (NULL when whole is 0)."""
    return F.expr(f"({scale} * {part}) div nullif({whole}, 0)")


def branch_base(tables: dict[str, DataFrame]) -> DataFrame:
    n, r = tables["nation"], tables["region"]
    key = F.col("n_nationkey")
    tier = (F.when(key % 3 == 0, F.lit(TIER_BY_KEY_MOD3[0]))
            .when(key % 3 == 1, F.lit(TIER_BY_KEY_MOD3[1]))
            .otherwise(F.lit(TIER_BY_KEY_MOD3[2])))
    base = (n.join(r, n["n_regionkey"] == r["r_regionkey"], "left")
            .select(key.cast("bigint").alias("branch_id"), tier.alias("tier"),
                    F.col("r_name").alias("province"), F.col("n_name").alias("city"),
                    (F.lit(2008) + key % 17).cast("int").alias("opening_year")))
    return base.select(
        "branch_id",
        branch_code("tier", "branch_id").alias("branch_code"),
        branch_name("tier", "branch_id").alias("branch_name"),
        "tier", "province", "city", "opening_year",
    )


def dim_employee(tables: dict[str, DataFrame], branches: DataFrame) -> DataFrame:
    s = tables["supplier"]
    # one row per nation: small, and broadcast so a nation holding most
    # suppliers never lands in one join task
    managers = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("_mgr_key"))
    k = F.col("s_suppkey")
    role = (F.when(k == F.col("_mgr_key"), F.lit("Manager"))
            .when(k % 2 == 0, F.lit("Advisor"))
            .otherwise(F.lit("Teller")))
    emp = s.join(managers, "s_nationkey", "left").select(
        k.alias("employee_id"), F.col("s_nationkey").cast("bigint").alias("branch_id"),
        role.alias("role"), F.lit("Supplier").alias("first_name"), F.col("s_name").alias("last_name"),
        iso_date(F.lit(2015) + k % 10, F.lit(1) + k % 12, F.lit(1) + k % 28).alias("hire_date"),
    )
    b = branches.select("branch_id", "branch_code", "tier", "province", "city")
    return emp.join(b, "branch_id", "left").select(
        "employee_id", "branch_id", "branch_code", "tier", "province", "city", "role",
        "first_name", "last_name", "hire_date")


def dim_branch(base: DataFrame, employees: DataFrame) -> DataFrame:
    role = F.col("role")
    counts = employees.groupBy("branch_id").agg(
        F.count_if(role == "Manager").cast("int").alias("manager_count"),
        F.count_if(role == "Advisor").cast("int").alias("advisor_count"),
        F.count_if(role == "Teller").cast("int").alias("teller_count"),
        F.count(F.lit(1)).cast("int").alias("employee_count"),
    )
    out = base.join(counts, "branch_id", "left")
    return out.select(
        "branch_id", "branch_code", "branch_name", "tier", "province", "city",
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
          for c in ("manager_count", "advisor_count", "teller_count", "employee_count")],
        "opening_year")


def supplier_month(tables: dict[str, DataFrame]) -> DataFrame:
    """Per supplier, ship year and month: the measures behind sales and targets."""
    li = tables["lineitem"].filter(F.col("l_shipdate").isNotNull())
    price = F.col("l_extendedprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    g = li.groupBy(F.col("l_suppkey").alias("employee_id"),
                   F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month_number")).agg(
        F.sum(F.when(F.col("l_returnflag") == LENDING_FLAG, price).otherwise(zero)).alias("_lending"),
        F.sum(F.when(F.col("l_returnflag") == INVESTING_FLAG, price).otherwise(zero)).alias("_investing"),
        F.sum(F.col("l_quantity").cast(MONEY)).alias("_banking"),
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(F.col("l_linestatus") == CLOSED_LINE_STATUS).alias("_closed"),
    )
    lei = (F.lit(10000) + _scaled_share("_closed", "_lines", 40000)).cast("double") / F.lit(10000.0)
    return g.select(
        "employee_id", "year", "month_number",
        F.col("_lending").cast("double").alias("lending"),
        F.col("_investing").cast("double").alias("investing"),
        F.col("_banking").cast("double").alias("banking_units"),
        lei.alias("lei"),
        F.col("_lines").cast("int").alias("lines"),
    )


def _with_employee(facts: DataFrame, employees: DataFrame) -> DataFrame:
    e = employees.select("employee_id", "branch_id", "branch_code", "role", "tier")
    return facts.join(e, "employee_id", "left")


def fact_sales(sales_months: DataFrame, employees: DataFrame) -> DataFrame:
    sm = _with_employee(sales_months, employees)
    return sm.select(
        "employee_id", "branch_id", "branch_code", "role", "tier", "year", "month_number",
        month_name("month_number").alias("month_name"),
        F.col("lending").alias("lending_actual"),
        F.col("investing").alias("investing_actual"),
        F.col("banking_units").alias("banking_units_actual"),
        F.col("lei").alias("lei_actual"))


def fact_targets(sales_months: DataFrame, employees: DataFrame) -> DataFrame:
    """A month's measures are the targets of the same month one year later."""
    sm = _with_employee(sales_months.withColumn("year", F.col("year") + 1), employees)
    tier = F.col("tier")
    by_tier = None
    for t, v in COMPLIANCE_TARGET_BY_TIER.items():
        by_tier = (F.when(tier == t, F.lit(v)) if by_tier is None else by_tier.when(tier == t, F.lit(v)))
    compliance = F.when(F.col("role") == "Manager", by_tier).otherwise(F.lit(0.0))
    return sm.select(
        "employee_id", "branch_id", "branch_code", "role", "tier", "year", "month_number",
        month_name("month_number").alias("month_name"),
        F.col("lending").alias("target_lending"),
        F.col("investing").alias("target_investing"),
        F.col("banking_units").alias("target_banking_units"),
        F.lit(4.0).alias("target_lei"),
        compliance.alias("target_compliance"))


def fact_lei_survey(sales_months: DataFrame, employees: DataFrame) -> DataFrame:
    sm = _with_employee(sales_months, employees)
    return sm.select(
        "employee_id", "branch_id", "year", "month_number",
        month_name("month_number").alias("month_name"),
        F.col("lines").alias("survey_response_count"),
        F.col("lei").alias("lei_score"))


def fact_compliance(tables: dict[str, DataFrame], branches: DataFrame) -> DataFrame:
    # orders are first counted per customer and month (a hot customer collapses
    # map-side), then joined to their nation and summed per nation and month
    o = tables["orders"].filter(F.col("o_orderdate").isNotNull())
    status = F.col("o_orderstatus")
    per_customer = o.groupBy("o_custkey", F.year("o_orderdate").alias("year"),
                             F.month("o_orderdate").alias("month_number")).agg(
        F.count(F.lit(1)).alias("_orders"),
        F.count_if(status != EXCEPTION_ORDER_STATUS).alias("_ok"),
        F.count_if(status == EXCEPTION_ORDER_STATUS).alias("_exceptions"))
    c = tables["customer"]
    g = (per_customer.join(c, per_customer["o_custkey"] == c["c_custkey"])
         .groupBy(F.col("c_nationkey").cast("bigint").alias("branch_id"), "year", "month_number")
         .agg(F.sum("_orders").alias("_orders"), F.sum("_ok").alias("_ok"),
              F.sum("_exceptions").alias("_exceptions")))
    scaled = _scaled_share("_ok", "_orders", 1_000_000)
    b = branches.select("branch_id", "branch_code", "tier", "province", "city")
    return g.join(b, "branch_id", "left").select(
        "branch_id", "branch_code", "year", "month_number",
        month_name("month_number").alias("month_name"),
        "tier", "province", "city",
        (scaled.cast("double") / F.lit(10000.0)).alias("compliance_score"),
        ((F.lit(1_000_000) - scaled).cast("double") / F.lit(10000.0)).alias("risk_score"),
        F.col("_exceptions").cast("int").alias("exceptions_count"))


def star_from_tpch(spark: SparkSession, sf_dir: str, stage_dir: str | None = None,
                   weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """The seven scorecard tables as lazy DataFrames over the driver tables.

    ``weights`` are the role weights, e.g. a stored table (``read_role_weights``); by default the fixed ones.

    With ``stage_dir`` (shared storage) the supplier x month aggregate is written
    there first, so sales, targets and survey facts share one scan of lineitem.
    """
    tables = read_tpch(spark, sf_dir)
    sales_months = supplier_month(tables)
    if stage_dir:
        path = f"{stage_dir.rstrip('/')}/sales_months"
        schema = sales_months.schema
        sales_months.write.mode("overwrite").parquet(path)
        sales_months = spark.read.schema(schema).parquet(path)
    base = branch_base(tables)
    employees = dim_employee(tables, base)
    # one row per base branch (left join to per-branch counts): same bound as the base
    branches = dim_branch(base, employees)
    return {
        "dim_branch": branches,
        "dim_employee": employees,
        "dim_role_weights": role_weights_frame(spark) if weights is None else weights,
        "fact_sales": fact_sales(sales_months, employees),
        "fact_targets": fact_targets(sales_months, employees),
        "fact_lei_survey": fact_lei_survey(sales_months, employees),
        "fact_compliance": fact_compliance(tables, base),
    }


def star_coverage(spark: SparkSession, sf_dir: str, star: dict[str, DataFrame]) -> DataFrame:
    """source_table, table_rows, undated_rows, star_rows, covered: the rows behind the facts.

    ``star_rows`` are the source rows that the facts were made of (survey responses for
    lineitem; for orders the rows of customers known in ``customer``, counted per branch and
    period that has a fact). ``covered`` holds when star_rows + undated_rows = table_rows.
    """
    tables = read_tpch(spark, sf_dir)
    lines = tables["lineitem"].agg(
        F.lit("lineitem").alias("source_table"), F.count(F.lit(1)).alias("table_rows"),
        F.count_if(F.col("l_shipdate").isNull()).alias("undated_rows"))
    surveyed = star["fact_lei_survey"].agg(
        F.lit("lineitem").alias("source_table"),
        F.coalesce(F.sum("survey_response_count"), F.lit(0)).cast("bigint").alias("star_rows"))
    orders = tables["orders"].agg(
        F.lit("orders").alias("source_table"), F.count(F.lit(1)).alias("table_rows"),
        F.count_if(F.col("o_orderdate").isNull()).alias("undated_rows"))
    per_period = (tables["orders"].groupBy("o_custkey", F.year("o_orderdate").alias("year"),
                                           F.month("o_orderdate").alias("month_number"))
                  .agg(F.count(F.lit(1)).alias("_orders"))
                  .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy(F.col("c_nationkey").cast("bigint").alias("branch_id"), "year", "month_number")
                  .agg(F.sum("_orders").alias("_orders")))
    placed = (per_period.join(star["fact_compliance"].select("branch_id", "year", "month_number").distinct(),
                              ["branch_id", "year", "month_number"], "left_semi")
              .agg(F.lit("orders").alias("source_table"),
                   F.coalesce(F.sum("_orders"), F.lit(0)).cast("bigint").alias("star_rows")))
    table_side = lines.unionByName(orders)
    return (table_side.join(surveyed.unionByName(placed), "source_table")
            .select("source_table", "table_rows", "undated_rows", "star_rows",
                    (F.col("star_rows") + F.col("undated_rows") == F.col("table_rows")).alias("covered")))
