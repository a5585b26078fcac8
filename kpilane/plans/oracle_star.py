"""ANSI SQL (DuckDB dialect) for the star and the layered views, as CTE text.

Each oracle query is ``WITH <star>, <views> SELECT ...``; DuckDB drops the CTEs a
query does not use.  Parity rules: integer arithmetic for shares, DECIMAL sums,
``x / NULLIF(y, 0)`` for ratios, explicit DOUBLE literals, INTEGER casts where
Spark yields int.
"""

from __future__ import annotations

# Fixed values of the scorecard, stated here apart from the engine, so that a wrong one there shows.
MONTHS = "January February March April May June July August September October November December".split()
WEIGHTS = [
    ("Advisor", "Lending", 35.0), ("Advisor", "Investing", 35.0),
    ("Advisor", "Banking units", 15.0), ("Advisor", "LEI customer score", 15.0),
    ("Teller", "Banking units", 70.0), ("Teller", "LEI customer score", 30.0),
    ("Manager", "Lending", 30.0), ("Manager", "Investing", 30.0), ("Manager", "Banking units", 15.0),
    ("Manager", "LEI customer score", 10.0), ("Manager", "Compliance / Risk", 15.0),
]

_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def month_name_sql(col: str) -> str:
    return f"CASE WHEN {col} BETWEEN 1 AND 12 THEN {_MONTHS}[{col}] END"


_WEIGHT_ROWS = ",\n    ".join(f"('{r}', '{m}', {w!r}e0)" for r, m, w in WEIGHTS)

STAR_CTES = f"""
kp_branch_base AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS branch_id,
         CASE WHEN n.n_nationkey % 3 = 0 THEN 'Small' WHEN n.n_nationkey % 3 = 1 THEN 'Medium' ELSE 'Large' END AS tier,
         r.r_name AS province, n.n_name AS city,
         CAST(2008 + n.n_nationkey % 17 AS INTEGER) AS opening_year
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
kp_branch AS (
  SELECT branch_id,
         upper(substr(tier, 1, 3)) || printf('%03d', branch_id) AS branch_code,
         printf('%s Branch %03d', tier, branch_id) AS branch_name,
         tier, province, city, opening_year
  FROM kp_branch_base
),
kp_mgr AS (SELECT s_nationkey, MIN(s_suppkey) AS mgr_key FROM supplier GROUP BY s_nationkey),
dim_employee AS (
  SELECT s.s_suppkey AS employee_id, CAST(s.s_nationkey AS BIGINT) AS branch_id,
         b.branch_code, b.tier, b.province, b.city,
         CASE WHEN s.s_suppkey = m.mgr_key THEN 'Manager'
              WHEN s.s_suppkey % 2 = 0 THEN 'Advisor' ELSE 'Teller' END AS role,
         'Supplier' AS first_name, s.s_name AS last_name,
         printf('%04d-%02d-%02d', 2015 + s.s_suppkey % 10, 1 + s.s_suppkey % 12, 1 + s.s_suppkey % 28) AS hire_date
  FROM supplier s
  LEFT JOIN kp_mgr m ON s.s_nationkey = m.s_nationkey
  LEFT JOIN kp_branch b ON b.branch_id = CAST(s.s_nationkey AS BIGINT)
),
kp_headcount AS (
  SELECT branch_id,
         count_if(role = 'Manager') AS manager_count, count_if(role = 'Advisor') AS advisor_count,
         count_if(role = 'Teller') AS teller_count, count(*) AS employee_count
  FROM dim_employee GROUP BY branch_id
),
dim_branch AS (
  SELECT b.branch_id, b.branch_code, b.branch_name, b.tier, b.province, b.city,
         CAST(COALESCE(h.manager_count, 0) AS INTEGER) AS manager_count,
         CAST(COALESCE(h.advisor_count, 0) AS INTEGER) AS advisor_count,
         CAST(COALESCE(h.teller_count, 0) AS INTEGER) AS teller_count,
         CAST(COALESCE(h.employee_count, 0) AS INTEGER) AS employee_count,
         b.opening_year
  FROM kp_branch b LEFT JOIN kp_headcount h ON h.branch_id = b.branch_id
),
dim_role_weights AS (
  SELECT * FROM (VALUES
    {_WEIGHT_ROWS}
  ) AS w(role, metric_name, weight_pct)
),
kp_supplier_month AS (
  SELECT l_suppkey AS employee_id,
         CAST(year(l_shipdate) AS INTEGER) AS yr,
         CAST(month(l_shipdate) AS INTEGER) AS month_number,
         CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS lending,
         CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS investing,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS banking_units,
         CAST(10000 + (40000 * count_if(l_linestatus = 'F')) // count(*) AS DOUBLE) / 10000.0e0 AS lei,
         CAST(count(*) AS INTEGER) AS lines
  FROM lineitem
  WHERE l_shipdate IS NOT NULL
  GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)
),
kp_sm_emp AS (
  SELECT sm.*, e.branch_id, e.branch_code, e.role, e.tier
  FROM kp_supplier_month sm LEFT JOIN dim_employee e ON e.employee_id = sm.employee_id
),
fact_sales AS (
  SELECT employee_id, branch_id, branch_code, role, tier, yr AS year, month_number,
         {month_name_sql('month_number')} AS month_name,
         lending AS lending_actual, investing AS investing_actual,
         banking_units AS banking_units_actual, lei AS lei_actual
  FROM kp_sm_emp
),
fact_targets AS (
  SELECT employee_id, branch_id, branch_code, role, tier, CAST(yr + 1 AS INTEGER) AS year, month_number,
         {month_name_sql('month_number')} AS month_name,
         lending AS target_lending, investing AS target_investing,
         banking_units AS target_banking_units, 4.0e0 AS target_lei,
         CASE WHEN role = 'Manager' THEN
              CASE WHEN tier = 'Small' THEN 60.0e0 WHEN tier = 'Medium' THEN 65.0e0 WHEN tier = 'Large' THEN 70.0e0 END
              ELSE 0.0e0 END AS target_compliance
  FROM kp_sm_emp
),
fact_lei_survey AS (
  SELECT employee_id, branch_id, yr AS year, month_number,
         {month_name_sql('month_number')} AS month_name,
         lines AS survey_response_count, lei AS lei_score
  FROM kp_sm_emp
),
kp_branch_month_orders AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS branch_id,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month_number,
         count(*) AS order_rows,
         (1000000 * count_if(o.o_orderstatus <> 'P')) // count(*) AS ok_scaled,
         CAST(count_if(o.o_orderstatus = 'P') AS INTEGER) AS exceptions_count
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate IS NOT NULL
  GROUP BY c.c_nationkey, year(o.o_orderdate), month(o.o_orderdate)
),
fact_compliance AS (
  SELECT g.branch_id, b.branch_code, g.year, g.month_number,
         {month_name_sql('g.month_number')} AS month_name,
         b.tier, b.province, b.city,
         CAST(g.ok_scaled AS DOUBLE) / 10000.0e0 AS compliance_score,
         CAST(1000000 - g.ok_scaled AS DOUBLE) / 10000.0e0 AS risk_score,
         g.exceptions_count
  FROM kp_branch_month_orders g LEFT JOIN kp_branch b ON b.branch_id = g.branch_id
)"""


_PILLAR_KEYS = ("lending", "investing", "banking_units", "lei", "compliance")


def _spread(values: str, suffix: str, n: int) -> str:
    """The first ``n`` entries of a list column as one column per pillar."""
    return ", ".join(f"{values}[{i + 1}] AS {_PILLAR_KEYS[i]}{suffix}" for i in range(n))


def _per_pillar(agg: str, names: list[str]) -> str:
    return ", ".join(f"{agg} FILTER (WHERE no = {i + 1}) AS {name}" for i, name in enumerate(names))


_ACTUALS = ["lending_actual", "investing_actual", "banking_units_actual", "lei_actual"]
_TARGETS = ["target_lending", "target_investing", "target_banking_units", "target_lei", "target_compliance"]
_WEIGHTS = [f"{k}_weight" for k in _PILLAR_KEYS]
_PERSON = "employee_id, branch_id, branch_code, role, first_name, last_name, year, month_number, month_name"
_EXACT_TOTAL = "CAST(SUM(CAST({} AS DECIMAL(38,6))) AS DOUBLE)"

# The views in long form: one row per pillar (kp_*_point), folded into lists in pillar order.
# Ranks are one more than the number of strictly better rows (or better distinct scores).
VIEW_CTES = f"""
kp_pillar AS (
  SELECT * FROM (VALUES (1, 'Lending', 'Lending'), (2, 'Investing', 'Investing'), (3, 'Banking', 'Banking units'),
                        (4, 'LEI', 'LEI customer score'), (5, 'Compliance', 'Compliance / Risk'))
    AS p(no, pillar_name, metric_name)
),
kp_weight AS (
  SELECT w.role, p.no, MAX(w.weight_pct) AS weight
  FROM dim_role_weights w JOIN kp_pillar p ON p.metric_name = w.metric_name GROUP BY w.role, p.no
),
kp_role_weights AS (SELECT role, {_per_pillar("MAX(weight)", _WEIGHTS[:4])} FROM kp_weight GROUP BY role),
manager_weights AS (SELECT {_per_pillar("MAX(weight)", _WEIGHTS)} FROM kp_weight WHERE role = 'Manager'),
kp_sale_point AS (
  SELECT employee_id, branch_id, year, month_number, month_name, no, [{", ".join(_ACTUALS)}][no] AS actual
  FROM fact_sales, kp_pillar WHERE no <= 4
),
kp_target_point AS (
  SELECT employee_id, branch_id, year, month_number, no, [{", ".join(_TARGETS)}][no] AS target
  FROM fact_targets, kp_pillar
),
kp_employee_point AS (
  SELECT p.employee_id, p.branch_id, who.branch_code, who.role, who.first_name, who.last_name,
         p.year, p.month_number, p.month_name, p.no,
         CASE WHEN who.role = 'Teller' AND p.no <= 2 THEN NULL
              WHEN goal.target <> 0 THEN p.actual / goal.target END AS pct,
         COALESCE(kp_weight.weight, 0.0e0) AS weight
  FROM kp_sale_point p
  JOIN kp_target_point goal ON (goal.employee_id, goal.year, goal.month_number, goal.no)
                             = (p.employee_id, p.year, p.month_number, p.no)
  JOIN dim_employee who ON who.employee_id = p.employee_id
  LEFT JOIN kp_weight ON kp_weight.role = who.role AND kp_weight.no = p.no
),
kp_employee_lists AS (
  SELECT {_PERSON}, list(pct ORDER BY no) AS pcts,
         list(COALESCE(pct, 0.0e0) * weight ORDER BY no) AS parts,
         list(CASE WHEN pct IS NULL THEN 0.0e0 ELSE weight END ORDER BY no) AS applicable
  FROM kp_employee_point GROUP BY {_PERSON}
),
vw_employee_monthly_score AS (
  SELECT {_PERSON}, {_spread("pcts", "_pct_to_target", 4)},
         (parts[1] + parts[2] + parts[3] + parts[4]) / 100.0e0 AS weighted_total_score
  FROM kp_employee_lists
),
kp_better_in_role AS (
  SELECT me.employee_id, me.year, me.month_number, COUNT(other.employee_id) AS better_rows,
         COUNT(DISTINCT other.weighted_total_score) AS better_scores
  FROM vw_employee_monthly_score me LEFT JOIN vw_employee_monthly_score other
    ON (other.role, other.year, other.month_number) = (me.role, me.year, me.month_number)
   AND other.weighted_total_score > me.weighted_total_score
  GROUP BY me.employee_id, me.year, me.month_number
),
kp_better_in_branch AS (
  SELECT me.employee_id, me.year, me.month_number, COUNT(other.employee_id) AS better_rows,
         COUNT(DISTINCT other.weighted_total_score) AS better_scores
  FROM vw_employee_monthly_score me LEFT JOIN vw_employee_monthly_score other
    ON (other.branch_id, other.year, other.month_number) = (me.branch_id, me.year, me.month_number)
   AND other.weighted_total_score > me.weighted_total_score
  GROUP BY me.employee_id, me.year, me.month_number
),
vw_employee_rank AS (
  SELECT score.*, 1 + r.better_rows AS rank_within_role, 1 + b.better_rows AS rank_within_branch
  FROM vw_employee_monthly_score score
  JOIN kp_better_in_role r USING (employee_id, year, month_number)
  JOIN kp_better_in_branch b USING (employee_id, year, month_number)
),
vw_employee_rank_dense AS (
  SELECT score.*, 1 + r.better_scores AS rank_within_role, 1 + b.better_scores AS rank_within_branch
  FROM vw_employee_monthly_score score
  JOIN kp_better_in_role r USING (employee_id, year, month_number)
  JOIN kp_better_in_branch b USING (employee_id, year, month_number)
),
vw_employee_scorecard_long AS (
  SELECT p.* EXCLUDE (no, pct, weight), kp_pillar.pillar_name, p.pct AS pct_to_target,
         ranked.weighted_total_score, ranked.rank_within_role, ranked.rank_within_branch
  FROM kp_employee_point p
  JOIN kp_pillar ON kp_pillar.no = p.no
  JOIN vw_employee_rank ranked ON (ranked.employee_id, ranked.year, ranked.month_number)
                                = (p.employee_id, p.year, p.month_number)
  WHERE p.pct IS NOT NULL
),
kp_branch_sale AS (
  SELECT branch_id, year, month_number, no, {_EXACT_TOTAL.format("actual")} AS actual
  FROM kp_sale_point GROUP BY branch_id, year, month_number, no
),
kp_branch_goal AS (
  SELECT branch_id, year, month_number, no, {_EXACT_TOTAL.format("target")} AS target
  FROM kp_target_point GROUP BY branch_id, year, month_number, no
),
branch_sales AS (
  SELECT branch_id, year, month_number, {_per_pillar("MAX(actual)", _ACTUALS)}
  FROM kp_branch_sale GROUP BY branch_id, year, month_number
),
branch_targets AS (
  SELECT branch_id, year, month_number, {_per_pillar("MAX(target)", _TARGETS)}
  FROM kp_branch_goal GROUP BY branch_id, year, month_number
),
kp_branch_point AS (
  SELECT done.branch_id, done.year, done.month_number, done.no,
         CASE WHEN goal.target <> 0 THEN done.actual / goal.target END AS pct, kp_weight.weight
  FROM (SELECT * FROM kp_branch_sale
        UNION ALL SELECT branch_id, year, month_number, 5, compliance_score FROM fact_compliance) done
  JOIN kp_branch_goal goal USING (branch_id, year, month_number, no)
  LEFT JOIN kp_weight ON kp_weight.role = 'Manager' AND kp_weight.no = done.no
),
kp_branch_lists AS (
  SELECT branch_id, year, month_number, list(pct ORDER BY no) AS pcts, list(pct * weight ORDER BY no) AS parts
  FROM kp_branch_point GROUP BY branch_id, year, month_number HAVING COUNT(*) = 5
),
vw_branch_monthly_score AS (
  SELECT d.branch_id, d.branch_code, d.branch_name, d.tier, f.year, f.month_number,
         {month_name_sql('f.month_number')} AS month_name, {_spread("pcts", "_pct_to_target", 5)},
         (parts[1] + parts[2] + parts[3] + parts[4] + parts[5]) / 100.0e0 AS weighted_total_score
  FROM kp_branch_lists f JOIN dim_branch d ON d.branch_id = f.branch_id
),
vw_branch_pacing AS (
  SELECT *, CASE WHEN weighted_total_score >= 1.0e0 THEN 'Green'
                 WHEN weighted_total_score >= 0.9e0 THEN 'Amber' ELSE 'Red' END AS rag_status
  FROM vw_branch_monthly_score
),
vw_branch_rank AS (
  SELECT me.*, 1 + (SELECT COUNT(*) FROM vw_branch_pacing other
                    WHERE other.year = me.year AND other.month_number = me.month_number
                      AND (other.weighted_total_score > me.weighted_total_score
                           OR (me.weighted_total_score IS NULL AND other.weighted_total_score IS NOT NULL)))
         AS branch_rank
  FROM vw_branch_pacing me
)"""


def with_views(select_sql: str, extra_ctes: str = "") -> str:
    """A full oracle query: the star and view CTEs (plus ``extra_ctes``) and ``select_sql``."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {STAR_CTES},{VIEW_CTES}{extra}\n{select_sql}"
