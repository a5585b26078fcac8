"""kpilane: a performance-scorecard engine written as lazy Spark DataFrame plans.

A *star* is a ``dict[str, DataFrame]`` holding the seven scorecard tables
(``dim_branch``, ``dim_employee``, ``dim_role_weights``, ``fact_sales``,
``fact_targets``, ``fact_lei_survey``, ``fact_compliance``).  Every view,
report, measure and quality job is a function ``star -> DataFrame`` (or
``DataFrame -> DataFrame``) that only adds nodes to a logical plan; nothing
is collected on the driver.
"""

__version__ = "0.1.0"
