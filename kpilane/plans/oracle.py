"""DuckDB oracle SQL for every catalogue query that SQL can express.

Each entry is the star and view CTEs (``oracle_star``) plus a final SELECT.
Column names match the Spark results one for one.
"""

from __future__ import annotations

import math

from kpilane.plans.oracle_star import month_name_sql, with_views
# Fixed values, stated here apart from the engine, so that a wrong one there shows.
SEASONAL_AMPLITUDE = 0.06
# tier, role, base lending, investing, banking units, compliance
BASE_TARGETS = [
    ("Small", "Advisor", 1800.0, 1400.0, 420.0, None),
    ("Small", "Teller", None, None, 560.0, None),
    ("Small", "Manager", 2500.0, 1800.0, 600.0, 88.0),
    ("Medium", "Advisor", 2400.0, 1800.0, 560.0, None),
    ("Medium", "Teller", None, None, 740.0, None),
    ("Medium", "Manager", 3200.0, 2300.0, 740.0, 90.0),
    ("Large", "Advisor", 3200.0, 2400.0, 740.0, None),
    ("Large", "Teller", None, None, 920.0, None),
    ("Large", "Manager", 4200.0, 3000.0, 920.0, 92.0),
]
# column stem, pillar_name of the long view, metric_name of the weights
PILLAR_NAMES = [
    ("lending", "Lending", "Lending"), ("investing", "Investing", "Investing"),
    ("banking_units", "Banking", "Banking units"), ("lei", "LEI", "LEI customer score"),
    ("compliance", "Compliance", "Compliance / Risk"),
]
LEADERBOARD_N = 10
H1 = (1, 6)
REPORT_PERIOD = (1997, 6)
RANGE_CHECKS = {
    "fact_targets": [("target_lending", 0, 1e9), ("target_investing", 0, 1e9), ("target_banking_units", 0, 1e9),
                     ("target_lei", 1, 5), ("target_compliance", 0, 100)],
    "fact_sales": [("lei_actual", 1, 5)],
    "fact_lei_survey": [("lei_score", 1, 5)],
    "fact_compliance": [("compliance_score", 80, 100), ("risk_score", 0, 25)],
}
_BAND = ("CASE WHEN weighted_total_score >= 1.0e0 THEN 'Green' WHEN weighted_total_score >= 0.9e0 THEN 'Amber' "
         "ELSE 'Red' END AS rag_status")

_EMP_COLS = ("employee_id, branch_id, branch_code, role, first_name, last_name, year, month_number, month_name, "
             "lending_pct_to_target, investing_pct_to_target, banking_units_pct_to_target, lei_pct_to_target")
_PCT5 = ["lending", "investing", "banking_units", "lei", "compliance"]


def _all(view: str) -> str:
    return with_views(f"SELECT * FROM {view}")


def _lit(v) -> str:
    return "NULL" if v is None else f"{float(v)!r}e0"


def _factor(m: str) -> str:
    return (f"(1.0e0 + {SEASONAL_AMPLITUDE!r}e0 * sin((CAST({m} AS DOUBLE) - 1.0e0) / 12.0e0 * "
            f"{2 * math.pi!r}e0))")


# --- measures -----------------------------------------------------------------------

_MEASURE_INPUTS = {
    "a": ("fact_sales", ["lending_actual", "investing_actual", "banking_units_actual", "lei_actual"]),
    "t": ("fact_targets", ["target_lending", "target_investing", "target_banking_units", "target_lei",
                           "target_compliance"]),
    "c": ("fact_compliance", ["compliance_score"]),
}
_RATIO = {
    "lending": ("a.lending_actual", "t.target_lending"),
    "investing": ("a.investing_actual", "t.target_investing"),
    "banking_units": ("a.banking_units_actual", "t.target_banking_units"),
    "lei": ("a.lei_actual", "t.target_lei"),
    "compliance": ("c.compliance_score", "t.target_compliance"),
}


def measure_sql(by: list[str], where: str | None = None, rollup: bool = False) -> str:
    """Subquery text: ratio-of-sums measures at grain ``by`` (Manager weights), with their band."""
    return f"SELECT *, {_BAND} FROM ({_measure_sql(by, where, rollup) if by else _company_measure_sql(where)}) banded"


def _measure_sql(by: list[str], where: str | None, rollup: bool) -> str:
    keys = ", ".join(by)
    parts = {}
    for alias, (table, cols) in _MEASURE_INPUTS.items():
        sums = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) AS {c}" for c in cols)
        src = (f"SELECT f.branch_id, f.year, f.month_number, {', '.join('f.' + c for c in cols)}, "
               f"db.branch_code, db.tier, db.province, db.city "
               f"FROM {table} f JOIN dim_branch db ON db.branch_id = f.branch_id")
        cond = f" WHERE {where}" if where else ""
        group = f"ROLLUP ({keys})" if rollup else keys
        level = f", GROUPING({keys}) AS grouping_level" if rollup else ""
        parts[alias] = f"(SELECT {keys}, {sums}{level} FROM ({src}) x{cond} GROUP BY {group})"
    join_keys = by + (["grouping_level"] if rollup else [])
    on_t = " AND ".join(f"a.{k} IS NOT DISTINCT FROM t.{k}" for k in join_keys)
    on_c = " AND ".join(f"a.{k} IS NOT DISTINCT FROM c.{k}" for k in join_keys)
    ratios = {k: f"({n} / NULLIF({d}, 0))" for k, (n, d) in _RATIO.items()}
    score = " + ".join(f"{ratios[k]} * mw.{k}_weight" for k in _PCT5)
    sel_keys = ", ".join(f"a.{k}" for k in join_keys)
    return (f"SELECT {sel_keys}, "
            + ", ".join(f"{ratios[k]} AS {k}_pct_to_target" for k in _PCT5)
            + f", ({score}) / 100.0e0 AS weighted_total_score "
            f"FROM {parts['a']} a JOIN {parts['t']} t ON {on_t} JOIN {parts['c']} c ON {on_c} "
            f"CROSS JOIN manager_weights mw")


def _company_measure_sql(where: str | None) -> str:
    """The company-wide grain: one global aggregate per source, kept when all have rows."""
    parts = {}
    for alias, (table, cols) in _MEASURE_INPUTS.items():
        sums = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) AS {c}" for c in cols)
        src = (f"SELECT f.branch_id, f.year, f.month_number, {', '.join('f.' + c for c in cols)}, "
               f"db.branch_code, db.tier, db.province, db.city "
               f"FROM {table} f JOIN dim_branch db ON db.branch_id = f.branch_id")
        cond = f" WHERE {where}" if where else ""
        parts[alias] = f"(SELECT {sums}, COUNT(*) AS n FROM ({src}) x{cond})"
    ratios = {k: f"({n} / NULLIF({d}, 0))" for k, (n, d) in _RATIO.items()}
    score = " + ".join(f"{ratios[k]} * mw.{k}_weight" for k in _PCT5)
    return ("SELECT " + ", ".join(f"{ratios[k]} AS {k}_pct_to_target" for k in _PCT5)
            + f", ({score}) / 100.0e0 AS weighted_total_score "
            f"FROM {parts['a']} a, {parts['t']} t, {parts['c']} c, manager_weights mw "
            f"WHERE a.n > 0 AND t.n > 0 AND c.n > 0")


def measure_role_sql(by: list[str]) -> str:
    """Role-grain measures: employee formula with the role's weights (compliance NULL)."""
    keys = ", ".join(by)
    parts = {}
    for alias, (table, cols) in (("a", _MEASURE_INPUTS["a"]),
                                 ("t", ("fact_targets", ["target_lending", "target_investing",
                                                         "target_banking_units", "target_lei"]))):
        sums = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) AS {c}" for c in cols)
        src = (f"SELECT f.employee_id, f.role, f.branch_id, f.year, f.month_number, {', '.join('f.' + c for c in cols)}, "
               f"db.branch_code, db.tier, db.province, db.city "
               f"FROM {table} f JOIN dim_branch db ON db.branch_id = f.branch_id")
        parts[alias] = f"(SELECT {keys}, {sums} FROM ({src}) x GROUP BY {keys})"
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM t.{k}" for k in by)
    ratio = {k: f"({n} / NULLIF({d}, 0))" for k, (n, d) in _RATIO.items() if k != "compliance"}
    for k in ("lending", "investing"):
        ratio[k] = f"(CASE WHEN a.role = 'Teller' THEN NULL ELSE {ratio[k]} END)"
    score = " + ".join(f"COALESCE({ratio[k]}, 0.0e0) * COALESCE(w.{k}_weight, 0.0e0)" for k in _PCT5[:4])
    return (f"SELECT *, {_BAND} FROM (SELECT {', '.join('a.' + k for k in by)}, "
            + ", ".join(f"{ratio[k]} AS {k}_pct_to_target" for k in _PCT5[:4])
            + f", CAST(NULL AS DOUBLE) AS compliance_pct_to_target, ({score}) / 100.0e0 AS weighted_total_score "
            f"FROM {parts['a']} a JOIN {parts['t']} t ON {on} LEFT JOIN kp_role_weights w ON w.role = a.role) banded")


# --- reports ------------------------------------------------------------------------

_PILLAR_LABELS = ", ".join(f"('{key}', '{name}', '{metric}')" for key, name, metric in PILLAR_NAMES)

PILLAR_DETAIL = with_views("""
SELECT l.employee_id, l.branch_id, l.role, l.year, l.month_number, l.pillar_name, l.pct_to_target,
       w.weight_pct, l.pct_to_target * w.weight_pct / 100.0e0 AS contribution, l.weighted_total_score
FROM vw_employee_scorecard_long l JOIN kp_weights_long w ON w.role = l.role AND w.pillar_name = l.pillar_name
""", extra_ctes=f"""
kp_labels AS (SELECT * FROM (VALUES {_PILLAR_LABELS}) AS t(pillar_key, pillar_name, metric_name)),
kp_weights_long AS (
  SELECT w.role, l.pillar_name, MAX(w.weight_pct) AS weight_pct
  FROM dim_role_weights w JOIN kp_labels l ON l.metric_name = w.metric_name
  GROUP BY w.role, l.pillar_name)""")


def _leaderboard(view: str, part: str, cols: str) -> str:
    return with_views(f"""
SELECT {cols} FROM (
  SELECT *, RANK() OVER (PARTITION BY {part} ORDER BY weighted_total_score DESC NULLS LAST) AS leaderboard_rank
  FROM {view}) WHERE leaderboard_rank <= {LEADERBOARD_N}""")


def _rank_in_role(where_after: str | None, where_before: str | None) -> str:
    inner = (f"SELECT employee_id, role, year, month_number, weighted_total_score, "
             f"RANK() OVER (PARTITION BY role ORDER BY weighted_total_score DESC NULLS LAST) AS rank_in_role "
             f"FROM vw_employee_monthly_score" + (f" WHERE {where_before}" if where_before else ""))
    return with_views(f"SELECT * FROM ({inner})" + (f" WHERE {where_after}" if where_after else ""))


# --- quality ------------------------------------------------------------------------

_RI_PAIRS = [
    ("fact_sales", "dim_employee", ["employee_id"]),
    ("fact_sales", "fact_targets", ["employee_id", "year", "month_number"]),
    ("fact_targets", "fact_sales", ["employee_id", "year", "month_number"]),
    ("fact_targets", "dim_employee", ["employee_id"]),
    ("fact_lei_survey", "dim_employee", ["employee_id"]),
    ("fact_compliance", "dim_branch", ["branch_id"]),
    ("dim_employee", "dim_branch", ["branch_id"]),
]


def _ri_sql() -> str:
    parts = []
    for child, parent, keys in _RI_PAIRS:
        on = " AND ".join(f"c.{k} = p.{k}" for k in keys)
        parts.append(
            f"SELECT '{child} -> {parent} on {', '.join(keys)}' AS check_name, COUNT(*) AS child_rows, "
            f"CAST(COUNT_IF(p.found IS NULL) AS BIGINT) AS orphan_rows FROM {child} c "
            f"LEFT JOIN (SELECT DISTINCT {', '.join(keys)}, TRUE AS found FROM {parent}) p ON {on}")
    return with_views("\nUNION ALL\n".join(parts))


def _range_sql() -> str:
    parts = []
    for table, bounds in RANGE_CHECKS.items():
        for col, lo, hi in bounds:
            parts.append(
                f"SELECT '{table}' AS table_name, '{col}' AS column_name, {_lit(lo)} AS low, "
                f"CAST({_lit(hi)} AS DOUBLE) AS high, COUNT({col}) AS rows_checked, "
                f"CAST(COUNT_IF({col} < {_lit(lo)}{f' OR {col} > {_lit(hi)}' if hi is not None else ''}) AS BIGINT) "
                f"AS out_of_range, "
                f"CAST(MIN({col}) AS DOUBLE) AS min_value, CAST(MAX({col}) AS DOUBLE) AS max_value FROM {table}")
    return with_views("\nUNION ALL\n".join(parts))


def _outliers_sql() -> str:
    measured = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, tier, role, {c} AS value FROM fact_targets"
        for c in ("target_lending", "target_investing", "target_banking_units"))
    return with_views("""
SELECT m.column_name, m.tier, m.role, MIN(q.q1 - 3.0e0 * (q.q3 - q.q1)) AS low, MIN(q.q3 + 3.0e0 * (q.q3 - q.q1)) AS high,
       COUNT(value) AS rows_checked,
       CAST(COUNT_IF(value < q.q1 - 3.0e0 * (q.q3 - q.q1) OR value > q.q3 + 3.0e0 * (q.q3 - q.q1)) AS BIGINT) AS out_of_range,
       MIN(value) AS min_value, MAX(value) AS max_value
FROM measured m JOIN (
  SELECT column_name, tier, role, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3
  FROM measured GROUP BY column_name, tier, role) q
  ON (q.column_name, q.tier, q.role) IS NOT DISTINCT FROM (m.column_name, m.tier, m.role)
GROUP BY m.column_name, m.tier, m.role""", extra_ctes=f"measured AS ({measured})")


_UNIQ = [("dim_branch", ["branch_id"]), ("dim_employee", ["employee_id"]),
         ("fact_sales", ["employee_id", "year", "month_number"]), ("fact_targets", ["employee_id", "year", "month_number"]),
         ("fact_compliance", ["branch_id", "year", "month_number"]), ("lineitem", ["l_orderkey", "l_linenumber"])]


def _uniq_sql() -> str:
    parts = []
    for table, keys in _UNIQ:
        k = ", ".join(keys)
        parts.append(
            f"SELECT '{table}' AS table_name, '{k}' AS key_columns, CAST(SUM(n) AS BIGINT) AS total_rows, "
            f"COUNT(*) AS distinct_keys, CAST(COUNT_IF(n > 1) AS BIGINT) AS duplicate_keys, "
            f"CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS rows_in_duplicates "
            f"FROM (SELECT {k}, COUNT(*) AS n FROM {table} GROUP BY {k})")
    return with_views("\nUNION ALL\n".join(parts))


_FANOUT = [("fact_sales x fact_targets on employee_id, year, month_number", "fact_sales", "fact_targets",
            ["employee_id", "year", "month_number"]),
           ("fact_sales x fact_targets on employee_id", "fact_sales", "fact_targets", ["employee_id"]),
           ("fact_sales x fact_compliance on branch_id, year, month_number", "fact_sales", "fact_compliance",
            ["branch_id", "year", "month_number"]),
           ("fact_sales x dim_employee on employee_id", "fact_sales", "dim_employee", ["employee_id"])]


def _fanout_sql() -> str:
    parts = []
    for name, left, right, keys in _FANOUT:
        k = ", ".join(keys)
        on = " AND ".join(f"l.{x} = r.{x}" for x in keys)
        parts.append(
            f"SELECT check_name, left_rows, joined_rows, joined_rows - left_rows AS extra_rows FROM ("
            f"SELECT '{name}' AS check_name, CAST(SUM(l.n) AS BIGINT) AS left_rows, "
            f"CAST(COALESCE(SUM(l.n * r.n), 0) AS BIGINT) AS joined_rows "
            f"FROM (SELECT {k}, COUNT(*) AS n FROM {left} GROUP BY {k}) l "
            f"LEFT JOIN (SELECT {k}, COUNT(*) AS n FROM {right} GROUP BY {k}) r ON {on})")
    return with_views("\nUNION ALL\n".join(parts))


_TOTALS = [
    (f"{c}: {fact} vs {total}", fact, c, total, c) for fact, total, columns in (
        ("fact_sales", "branch_sales", "lending_actual investing_actual banking_units_actual lei_actual"),
        ("fact_targets", "branch_targets",
         "target_lending target_investing target_banking_units target_lei target_compliance"))
    for c in columns.split()]


def _totals_sql() -> str:
    parts = []
    for name, a, ca, b, cb in _TOTALS:
        parts.append(
            f"SELECT '{name}' AS check_name, CAST(ta AS DOUBLE) AS total_a, CAST(tb AS DOUBLE) AS total_b, "
            f"CAST(COALESCE(ta, 0) - COALESCE(tb, 0) AS DOUBLE) AS difference FROM "
            f"(SELECT SUM(CAST({ca} AS DECIMAL(38,6))) AS ta FROM {a}), "
            f"(SELECT SUM(CAST({cb} AS DECIMAL(38,6))) AS tb FROM {b})")
    return with_views("\nUNION ALL\n".join(parts))


def _reconcile_sql() -> str:
    cols = [f"{k}_pct_to_target" for k in _PCT5] + ["weighted_total_score"]
    keys = ["branch_id", "year", "month_number"]
    on = " AND ".join(f"m.{k} IS NOT DISTINCT FROM v.{k}" for k in keys)
    sel_keys = ", ".join(f"CASE WHEN m.present IS NULL THEN v.{k} ELSE m.{k} END AS {k}" for k in keys)
    same = " AND ".join(
        f"COALESCE((m.{c} IS NULL AND v.{c} IS NULL) OR ABS(m.{c} - v.{c}) <= 5e-05, FALSE)" for c in cols)
    diff = ", ".join(f"COALESCE(ABS(m.{c} - v.{c}), 0.0e0)" for c in cols)
    return with_views(
        f"SELECT {sel_keys}, CASE WHEN v.present IS NULL THEN 'left_only' WHEN m.present IS NULL THEN 'right_only' "
        f"WHEN {same} THEN 'match' ELSE 'differ' END AS status, GREATEST({diff}) AS max_abs_diff "
        f"FROM (SELECT *, TRUE AS present FROM ({measure_sql(keys)})) m "
        f"FULL OUTER JOIN (SELECT *, TRUE AS present FROM vw_branch_monthly_score) v ON {on}")


def _reconcile_employee_sql() -> str:
    measured = measure_role_sql(["employee_id", "role", "year", "month_number"])
    cols = [f"{k}_pct_to_target" for k in _PCT5[:4]] + ["weighted_total_score"]
    same = " AND ".join(f"(m.{c} IS NOT DISTINCT FROM v.{c} OR COALESCE(ABS(m.{c} - v.{c}) <= 5e-05, FALSE))"
                        for c in cols)
    off = ", ".join(f"COALESCE(ABS(m.{c} - v.{c}), 0.0e0)" for c in cols)
    return with_views(
        f"SELECT employee_id, year, month_number, CASE WHEN v.role IS NULL THEN 'left_only' WHEN m.role IS NULL "
        f"THEN 'right_only' WHEN {same} THEN 'match' ELSE 'differ' END AS status, GREATEST({off}) AS max_abs_diff "
        f"FROM ({measured}) m FULL JOIN vw_employee_monthly_score v USING (employee_id, year, month_number)")


def _tied_sql(better: str) -> str:
    """Ranks of scores cut to one decimal, as counts of better rows or better distinct scores."""
    count = {p: f"1 + (SELECT COUNT({better}o.s) FROM cut o WHERE o.{p} = cut.{p} AND o.year = cut.year "
                f"AND o.month_number = cut.month_number AND o.s > cut.s)" for p in ("role", "branch_id")}
    return with_views(
        f"SELECT employee_id, branch_id, role, year, month_number, s AS weighted_total_score, "
        f"{count['role']} AS rank_within_role, {count['branch_id']} AS rank_within_branch FROM cut",
        extra_ctes="cut AS (SELECT *, FLOOR(weighted_total_score * 10.0e0) / 10.0e0 AS s "
                   "FROM vw_employee_monthly_score)")


# --- planning -----------------------------------------------------------------------

_BASE_ROWS = ", ".join(
    f"('{t}', '{r}', {_lit(a)}, {_lit(b)}, {_lit(c)}, {_lit(d)})" for t, r, a, b, c, d in BASE_TARGETS)

TARGET_PLAN = with_views(f"""
SELECT e.employee_id, e.branch_id, e.branch_code, e.role, e.tier, m.month_number,
       {month_name_sql('m.month_number')} AS month_name,
       ROUND(COALESCE(b.base_lending, 0.0e0) * {_factor('m.month_number')}, 2) AS target_lending,
       ROUND(COALESCE(b.base_investing, 0.0e0) * {_factor('m.month_number')}, 2) AS target_investing,
       ROUND(COALESCE(b.base_banking_units, 0.0e0) * {_factor('m.month_number')}, 2) AS target_banking_units,
       4.0e0 AS target_lei,
       ROUND(COALESCE(b.base_compliance, 0.0e0) * {_factor('m.month_number')}, 2) AS target_compliance
FROM dim_employee e
LEFT JOIN (SELECT * FROM (VALUES {_BASE_ROWS}) AS t(tier, role, base_lending, base_investing,
           base_banking_units, base_compliance)) b ON b.tier = e.tier AND b.role = e.role
CROSS JOIN (SELECT CAST(range AS INTEGER) AS month_number FROM range(1, 13)) m""")

MONTH_CALENDAR = with_views(f"""
SELECT year, month_number, {month_name_sql('month_number')} AS month_name,
       CAST(quarter(make_date(year, month_number, 1)) AS INTEGER) AS quarter,
       CAST(day(last_day(make_date(year, month_number, 1))) AS INTEGER) AS days_in_month,
       strftime(make_date(year, month_number, 1), '%Y-%m-%d') AS first_day,
       ROUND({_factor('month_number')}, 6) AS seasonal_factor,
       source_rows
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month_number,
             COUNT(*) AS source_rows
      FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)""")


def _clamp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE LEAST(GREATEST({x}, {_lit(lo)}), {_lit(hi)}) END"


def _oor(x: str, lo: float, hi: float) -> str:
    return f"({x} IS NOT NULL AND NOT ({x} BETWEEN {_lit(lo)} AND {_lit(hi)}))"


_CLAMPED = _clamp("compliance_score", 80.0, 100.0)
CLAMP_SCORES = with_views(f"""
SELECT branch_id, year, month_number, compliance_score, {_CLAMPED} AS compliance_clamped,
       {_oor('compliance_score', 80.0, 100.0)} AS compliance_out_of_range, risk_score,
       {_clamp(f'(100.0e0 - {_CLAMPED})', 0.0, 25.0)} AS risk_from_compliance,
       {_oor('risk_score', 0.0, 25.0)} AS risk_out_of_range
FROM fact_compliance""")

ENRICH_FACTS = with_views("""
SELECT fs.employee_id, e.branch_id, e.branch_code, e.role, e.tier, fs.year, fs.month_number, fs.month_name,
       CASE WHEN e.role = 'Teller' THEN 0.0e0 ELSE fs.lending_actual END AS lending_actual,
       CASE WHEN e.role = 'Teller' THEN 0.0e0 ELSE fs.investing_actual END AS investing_actual,
       fs.banking_units_actual, fs.lei_actual, e.employee_id IS NOT NULL AS employee_found
FROM fact_sales fs LEFT JOIN dim_employee e ON e.employee_id = fs.employee_id""")

ORACLE: dict[str, str] = {
    "dim_branch": _all("dim_branch"),
    "dim_employee": _all("dim_employee"),
    "fact_sales": _all("fact_sales"),
    "fact_targets": _all("fact_targets"),
    "fact_compliance": _all("fact_compliance"),
    "fact_lei_survey": _all("fact_lei_survey"),
    "employee_monthly_score": _all("vw_employee_monthly_score"),
    "employee_rank": _all("vw_employee_rank"),
    "employee_rank_dense": _all("vw_employee_rank_dense"),
    "employee_rank_tied": _tied_sql(""),
    "employee_rank_tied_dense": _tied_sql("DISTINCT "),
    "employee_scorecard_long": _all("vw_employee_scorecard_long"),
    "role_weights_pivot": with_views(
        "SELECT * FROM kp_role_weights WHERE role IN (SELECT role FROM dim_employee)"),
    "manager_weights": with_views(
        "SELECT " + ", ".join(f"max(weight_pct) FILTER (WHERE metric_name = '{metric}') AS {key}_weight"
                              for key, _, metric in PILLAR_NAMES)
        + " FROM dim_role_weights WHERE role = 'Manager' AND role IN (SELECT role FROM dim_employee)"),
    "branch_sales": _all("branch_sales"),
    "branch_targets": _all("branch_targets"),
    "branch_monthly_score": _all("vw_branch_monthly_score"),
    "branch_pacing": _all("vw_branch_pacing"),
    "branch_rank": _all("vw_branch_rank"),
    "employee_rag": with_views(
        "SELECT employee_id, branch_id, role, year, month_number, weighted_total_score, "
        "CASE WHEN weighted_total_score >= 1.0e0 THEN 'Green' WHEN weighted_total_score >= 0.9e0 THEN 'Amber' "
        "ELSE 'Red' END AS rag_status FROM vw_employee_monthly_score"),
    "score_normalized": with_views(
        f"SELECT {_EMP_COLS}, (parts[1] + parts[2] + parts[3] + parts[4]) "
        "/ NULLIF(applicable[1] + applicable[2] + applicable[3] + applicable[4], 0) AS weighted_total_score "
        "FROM vw_employee_monthly_score JOIN (SELECT employee_id, year, month_number, parts, applicable "
        "FROM kp_employee_lists) USING (employee_id, year, month_number)"),
    "safe_divide": with_views(
        "SELECT fs.employee_id, fs.year, fs.month_number, "
        "fs.lending_actual / NULLIF(ft.target_lending, 0) AS lending_ratio, "
        "fs.investing_actual / NULLIF(ft.target_investing, 0) AS investing_ratio, "
        "fs.banking_units_actual / NULLIF(ft.target_banking_units, 0) AS banking_units_ratio, "
        "fs.lei_actual / NULLIF(ft.target_lei, 0) AS lei_ratio "
        "FROM fact_sales fs JOIN fact_targets ft ON ft.employee_id = fs.employee_id "
        "AND ft.year = fs.year AND ft.month_number = fs.month_number"),
    "top3_advisors_latest_month": with_views(
        "SELECT employee_id, branch_id, branch_code, first_name, last_name, weighted_total_score, "
        "rank_within_role, rank_within_branch FROM vw_employee_rank "
        "WHERE role = 'Advisor' AND 12 * year + month_number = (SELECT MAX(12 * year + month_number) "
        "FROM vw_employee_rank WHERE role = 'Advisor') ORDER BY weighted_total_score DESC, employee_id LIMIT 3"),
    "leaderboard_employees": _leaderboard(
        "vw_employee_monthly_score", "role, year, month_number",
        "role, year, month_number, leaderboard_rank, employee_id, branch_id, branch_code, weighted_total_score"),
    "leaderboard_branches": _leaderboard(
        "vw_branch_monthly_score", "year, month_number",
        "year, month_number, leaderboard_rank, branch_id, branch_code, branch_name, tier, weighted_total_score"),
    "pillar_detail": PILLAR_DETAIL,
    "branch_team": with_views(
        "SELECT b.branch_id, b.year, b.month_number, b.branch_code, b.branch_name, b.tier, b.rag_status, "
        "b.weighted_total_score AS branch_score, b.branch_rank, e.employee_id, e.role, e.first_name, "
        "e.last_name, e.weighted_total_score AS employee_score, e.rank_within_branch, "
        + ", ".join(f"b.{k}_pct_to_target" for k in _PCT5) + " "
        "FROM vw_branch_rank b JOIN vw_employee_rank e ON e.branch_id = b.branch_id "
        "AND e.year = b.year AND e.month_number = b.month_number"),
    "branch_page_pillars": with_views("\nUNION ALL\n".join(
        f"SELECT branch_id, year, month_number, branch_rank, '{label}' AS pillar_name, {k}_pct_to_target AS pct_to_target, "
        f"(SELECT {k}_weight FROM manager_weights) AS weight_pct, CASE WHEN {k}_pct_to_target >= 1.0e0 THEN 'Green' "
        f"WHEN {k}_pct_to_target >= 0.9e0 THEN 'Amber' ELSE 'Red' END AS rag_status FROM vw_branch_rank"
        for k, label in zip(_PCT5, ("Lending", "Investing", "Banking", "LEI", "Compliance")))),
    "top_advisors_of_period": with_views(
        "SELECT employee_id, branch_id, branch_code, first_name, last_name, weighted_total_score, rank_within_role, "
        f"rank_within_branch FROM vw_employee_rank WHERE year = {REPORT_PERIOD[0]} AND month_number = {REPORT_PERIOD[1]} "
        f"AND role = 'Advisor' ORDER BY weighted_total_score DESC, employee_id LIMIT {LEADERBOARD_N}"),
    "lazy_employee_rank": _all("vw_employee_rank"),
    "province_performance": with_views(measure_sql(["province", "year", "month_number"])),
    "branch_rank_in_province": with_views(
        "SELECT db.province, p.year, p.month_number, RANK() OVER (PARTITION BY db.province, p.year, p.month_number "
        "ORDER BY p.weighted_total_score DESC NULLS LAST) AS province_rank, p.branch_id, p.branch_code, "
        "p.weighted_total_score, p.rag_status FROM vw_branch_pacing p JOIN dim_branch db "
        "ON db.branch_id = p.branch_id"),
    "measure_by_grain": with_views(measure_sql(["tier", "year"], where=f"month_number BETWEEN {H1[0]} AND {H1[1]}")),
    "measure_rollup": with_views(measure_sql(["year", "month_number", "province", "tier"], rollup=True)),
    "measure_by_role": with_views(measure_role_sql(["role", "year", "month_number"])),
    "measure_company": with_views(measure_sql([])),
    "rank_all_except": _rank_in_role(f"month_number > {H1[1]}", None),
    "rank_all_selected": _rank_in_role(None, f"month_number > {H1[1]}"),
    "rank_distributed": with_views(
        "SELECT employee_id, role, year, month_number, weighted_total_score, RANK() OVER (PARTITION BY role "
        "ORDER BY weighted_total_score DESC NULLS LAST) AS rank_in_role_all_months FROM vw_employee_monthly_score"),
    "view_row_counts": with_views("\nUNION ALL\n".join(
        f"SELECT '{v}' AS view_name, COUNT(*) AS row_count FROM {v}" for v in
        ("vw_employee_monthly_score", "vw_employee_rank", "vw_employee_scorecard_long",
         "vw_branch_monthly_score", "vw_branch_pacing"))),
    "referential_integrity": _ri_sql(),
    "target_range_check": _range_sql(),
    "target_outliers": _outliers_sql(),
    "key_uniqueness": _uniq_sql(),
    "join_fanout": _fanout_sql(),
    "totals_reconciliation": _totals_sql(),
    "reconcile_4dp": _reconcile_sql(),
    "reconcile_employee_4dp": _reconcile_employee_sql(),
    "reconcile_ranks": with_views(
        "SELECT employee_id, year, month_number, CASE WHEN off_role = 0 AND off_branch = 0 THEN 'match' "
        "ELSE 'differ' END AS status, CAST(GREATEST(off_role, off_branch) AS DOUBLE) AS max_abs_diff "
        "FROM (SELECT employee_id, year, month_number, "
        "ABS(rank_within_role - RANK() OVER (PARTITION BY role, year, month_number "
        "ORDER BY weighted_total_score DESC)) AS off_role, "
        "ABS(rank_within_branch - RANK() OVER (PARTITION BY branch_id, year, month_number "
        "ORDER BY weighted_total_score DESC)) AS off_branch FROM vw_employee_rank)"),
    "rank_consistency": with_views("\nUNION ALL\n".join(
        f"SELECT '{rank}' AS rank_column, CAST(SUM(n) AS BIGINT) AS rows_ranked, COUNT(*) AS distinct_ranks, "
        f"CAST(COUNT_IF(low <> high OR r <> 1 + ahead) AS BIGINT) AS broken_ranks, "
        f"CAST(COUNT_IF(ahead = 0 AND r <> 1) AS BIGINT) AS unstarted FROM ("
        f"SELECT *, COALESCE(SUM(n) OVER (PARTITION BY {part}, year, month_number ORDER BY r "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM ("
        f"SELECT {part}, year, month_number, {rank} AS r, COUNT(*) AS n, MIN(weighted_total_score) AS low, "
        f"MAX(weighted_total_score) AS high FROM vw_employee_rank GROUP BY {part}, year, month_number, {rank}))"
        for rank, part in (("rank_within_role", "role"), ("rank_within_branch", "branch_id")))),
    "star_coverage": with_views(
        "SELECT *, star_rows + undated_rows = table_rows AS covered FROM ("
        "SELECT 'lineitem' AS source_table, COUNT(*) AS table_rows, "
        "CAST(COUNT_IF(l_shipdate IS NULL) AS BIGINT) AS undated_rows, "
        "(SELECT CAST(SUM(survey_response_count) AS BIGINT) FROM fact_lei_survey) AS star_rows FROM lineitem "
        "UNION ALL SELECT 'orders', COUNT(*), CAST(COUNT_IF(o_orderdate IS NULL) AS BIGINT), "
        "(SELECT CAST(SUM(order_rows) AS BIGINT) FROM kp_branch_month_orders) FROM orders)"),
    "weight_sum_check": with_views(
        "SELECT s.role, s.employees, w.total_weight, COALESCE(w.pillar_rows, 0) AS pillar_rows, "
        "COALESCE(w.total_weight = 100.0e0, FALSE) AS sums_to_expected "
        "FROM (SELECT role, COUNT(*) AS employees FROM dim_employee GROUP BY role) s "
        "LEFT JOIN (SELECT role, SUM(weight_pct) AS total_weight, COUNT(*) AS pillar_rows "
        "FROM dim_role_weights GROUP BY role) w ON w.role = s.role"),
    "headcount_check": with_views(
        "SELECT b.branch_id, b.manager_count, b.advisor_count, b.teller_count, b.employee_count, "
        "COALESCE(a.actual_managers, 0) AS actual_managers, COALESCE(a.actual_advisors, 0) AS actual_advisors, "
        "COALESCE(a.actual_tellers, 0) AS actual_tellers, COALESCE(a.actual_employees, 0) AS actual_employees, "
        "COALESCE(b.manager_count = COALESCE(a.actual_managers, 0) AND b.advisor_count = COALESCE(a.actual_advisors, 0) "
        "AND b.teller_count = COALESCE(a.actual_tellers, 0) AND b.employee_count = COALESCE(a.actual_employees, 0), "
        "FALSE) AS headcount_matches "
        "FROM dim_branch b LEFT JOIN (SELECT branch_id, CAST(count_if(role = 'Manager') AS INTEGER) AS actual_managers, "
        "CAST(count_if(role = 'Advisor') AS INTEGER) AS actual_advisors, "
        "CAST(count_if(role = 'Teller') AS INTEGER) AS actual_tellers, CAST(count(*) AS INTEGER) AS actual_employees "
        "FROM (SELECT employee_id, branch_id, role FROM fact_sales UNION SELECT employee_id, branch_id, role FROM fact_targets) "
        "GROUP BY branch_id) a ON a.branch_id = b.branch_id"),
    "target_plan": TARGET_PLAN,
    "month_calendar": MONTH_CALENDAR,
    "branch_labels": with_views(
        "SELECT branch_id, tier, upper(substr(tier, 1, 3)) || printf('%03d', branch_id) AS branch_code, "
        "printf('%s Branch %03d', tier, branch_id) AS branch_name "
        "FROM (SELECT DISTINCT branch_id, tier FROM fact_sales)"),
    "enrich_facts": ENRICH_FACTS,
    "clamp_scores": CLAMP_SCORES,
    "clamp_survey": with_views(
        f"SELECT employee_id, year, month_number, lei_score, {_clamp('lei_score', 1.0, 5.0)} AS lei_clamped, "
        f"{_oor('lei_score', 1.0, 5.0)} AS lei_out_of_range FROM fact_lei_survey"),
    "sales_without_targets": with_views(
        "SELECT s.* FROM fact_sales s WHERE NOT EXISTS (SELECT 1 FROM fact_targets t "
        "WHERE t.employee_id = s.employee_id AND t.year = s.year AND t.month_number = s.month_number)"),
    "csv_roundtrip": _all("fact_sales"),
    "csv_typed_load": _all("dim_employee"),
    "csv_empty_load": with_views("SELECT * FROM fact_compliance WHERE FALSE"),
    "star_period_refresh": _all("fact_sales"),
    "view_export_refresh": _all("vw_branch_pacing"),
    "ordered_view_export": with_views(
        "SELECT employee_id, role, year, month_number, weighted_total_score, "
        "ROW_NUMBER() OVER (PARTITION BY year, month_number ORDER BY employee_id) AS position "
        "FROM vw_employee_monthly_score"),
}
