"""The golden fixture: a one-month star that exercises every scoring edge case."""

from kpilane.schemas import SCHEMAS
from kpilane.sources.star import role_weights_frame

# employee -> (branch, role); 8 and 9 are facts without a dim_employee row
EMPLOYEES = {1: (1, "Manager"), 2: (1, "Advisor"), 3: (1, "Teller"), 4: (2, "Manager"),
             5: (2, "Advisor"), 6: (2, "Advisor"), 7: (2, "Intern"), 10: (1, "Advisor"),
             11: (3, "Teller")}
BRANCHES = {1: ("Small", 88.0), 2: ("Medium", 81.0), 3: ("Large", 90.0)}
# employee -> branch, actual (lending, investing, banking, lei), target (.., compliance) or None
FACTS = {
    1: (1, (2500, 1800, 660, 3), (2500, 1800, 600, 4, 88)),
    2: (1, (900, 1400, 420, 4), (1800, 1400, 420, 4, 0)),
    3: (1, (0, 0, 616, 2), (0, 0, 560, 4, 0)),
    4: (2, (3200, 2300, 740, 4), (3200, 2300, 740, 4, 90)),
    5: (2, (2400, 1800, 560, 4), (2400, 1800, 560, 4, 0)),
    6: (2, (2400, 1800, 560, 4), (2400, 1800, 560, 4, 0)),
    7: (2, (10, 10, 10, 4), (10, 10, 10, 4, 0)),
    8: (2, (100, 100, 100, 4), (100, 100, 100, 4, 0)),
    9: (1, (50, 50, 50, 4), None),
    10: (1, (100, 1400, 420, 4), (0, 1400, 420, 4, 0)),
    11: (3, (0, 0, 560, 4), (0, 0, 560, 4, 0)),
}

# expected employee results: pct (lending, investing, banking, lei), score,
# (rank in role, dense), (rank in branch, dense)
EXPECTED_EMPLOYEE = {
    1: ((1.0, 1.0, 1.1, 0.75), 0.84, (2, 2), (2, 2)),
    2: ((0.5, 1.0, 1.0, 1.0), 0.825, (3, 2), (3, 3)),
    3: ((None, None, 1.1, 0.5), 0.92, (2, 2), (1, 1)),
    4: ((1.0, 1.0, 1.0, 1.0), 0.85, (1, 1), (3, 2)),
    5: ((1.0, 1.0, 1.0, 1.0), 1.0, (1, 1), (1, 1)),
    6: ((1.0, 1.0, 1.0, 1.0), 1.0, (1, 1), (1, 1)),
    7: ((1.0, 1.0, 1.0, 1.0), 0.0, (1, 1), (4, 3)),
    10: ((None, 1.0, 1.0, 1.0), 0.65, (4, 3), (4, 4)),
    11: ((None, None, 1.0, 1.0), 1.0, (1, 1), (1, 1)),
}
EXPECTED_BRANCH = {
    1: ((3550 / 4300, 4650 / 4600, 2166 / 2000, 17 / 16, 1.0), 0.9696352881698687, "Amber", 2),
    2: ((1.0, 1.0, 1.0, 1.0, 0.9), 0.985, "Amber", 1),
    3: ((None, None, 1.0, 1.0, None), None, "Red", 3),
}


def golden_star(spark):
    month, name = 1, "January"
    branches = [(b, f"{t[:3].upper()}{b:03d}", f"{t} Branch {b:03d}", t, "Province", "City",
                 1, 1, 1, 3, 2010) for b, (t, _) in BRANCHES.items()]
    employees = [(e, b, f"{BRANCHES[b][0][:3].upper()}{b:03d}", BRANCHES[b][0], "Province", "City", r,
                  f"First{e}", f"Last{e}", "2020-01-01") for e, (b, r) in EMPLOYEES.items()]
    sales, targets, survey = [], [], []
    for e, (b, act, tgt) in FACTS.items():
        role = EMPLOYEES.get(e, (b, None))[1]
        tier = BRANCHES[b][0]
        sales.append((e, b, None, role, tier, month, name, *[float(x) for x in act]))
        survey.append((e, b, month, name, 10, float(act[3])))
        if tgt is not None:
            targets.append((e, b, None, role, tier, month, name, *[float(x) for x in tgt]))
    compliance = [(b, None, month, name, t, "Province", "City", c, 100.0 - c, 1)
                  for b, (t, c) in BRANCHES.items()]
    return {
        "dim_branch": spark.createDataFrame(branches, SCHEMAS["dim_branch"]),
        "dim_employee": spark.createDataFrame(employees, SCHEMAS["dim_employee"]),
        "dim_role_weights": role_weights_frame(spark),
        "fact_sales": spark.createDataFrame(sales, SCHEMAS["fact_sales"]),
        "fact_targets": spark.createDataFrame(targets, SCHEMAS["fact_targets"]),
        "fact_lei_survey": spark.createDataFrame(survey, SCHEMAS["fact_lei_survey"]),
        "fact_compliance": spark.createDataFrame(compliance, SCHEMAS["fact_compliance"]),
    }
