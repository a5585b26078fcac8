"""Incremental refresh of the month-partitioned views as new fact files land.

The scorecard rebuilds its views from scratch whenever data changes.  Every
view is month-local (ranks partition by month, branch sums group by month), so
a Structured Streaming job over the landing folder can refresh only the months
present in each micro-batch and replace exactly those month partitions.
"""

from kpilane.streaming.refresh import refresh_months, start_monthly_refresh

__all__ = ["refresh_months", "start_monthly_refresh"]
