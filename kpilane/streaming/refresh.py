"""Month-partition refresh driven by a file stream of fact rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kpilane.operators import branch as br
from kpilane.operators import employee as emp
from kpilane.schemas import PERIOD_TABLES, table_schema
from kpilane.sources.star import load_star


def _restrict(star: Mapping[str, DataFrame], periods: DataFrame, period_cols) -> dict[str, DataFrame]:
    """The star with every fact limited to ``periods`` (a left-semi join; no collect)."""
    out = dict(star)
    for t in PERIOD_TABLES:
        out[t] = star[t].join(periods, list(period_cols), "left_semi")
    return out


def default_views(star: Mapping[str, DataFrame], period_cols=("month_number",)) -> dict[str, DataFrame]:
    scores = emp.employee_monthly_score(star, period_cols=period_cols)
    branch = br.branch_pacing(br.branch_monthly_score(star, period_cols=period_cols))
    return {"vw_employee_rank": emp.employee_rank(scores, period_cols=period_cols),
            "vw_branch_pacing": br.branch_rank(branch, keys=list(period_cols))}


def refresh_months(star: Mapping[str, DataFrame], months: DataFrame, out_dir: str,
                   views: Callable[..., dict[str, DataFrame]] = default_views,
                   period_cols=("month_number",)) -> None:
    """Recompute the views for the periods in ``months`` and replace only those partitions.

    Rewriting a period is idempotent, so a micro-batch replayed after a failure
    leaves the same result.  With ``period_cols=("year", "month_number")`` the
    partitions are per year and month.
    """
    periods = months.select(*period_cols).distinct()
    for name, df in views(_restrict(star, periods, period_cols), period_cols=period_cols).items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*period_cols).parquet(f"{out_dir.rstrip('/')}/{name}"))


def start_monthly_refresh(spark: SparkSession, star_dir: str, out_dir: str, checkpoint: str,
                          landing_table: str | Sequence[str] = PERIOD_TABLES, available_now: bool = True,
                          period_cols=("month_number",)) -> StreamingQuery:
    """Stream new Parquet files of the facts (all, or those named) under ``star_dir``; refresh their periods.

    The facts' streams are one stream of period keys, so new sales, targets, survey or compliance rows of a
    period each refresh it.  Each micro-batch reduces to its distinct months (at most the number of
    periods), reloads the star (which now includes the new files) and rewrites
    those month partitions of every view.  ``checkpoint`` must be on shared
    storage; the stream then restarts where it stopped after a failure.
    """
    tables = [landing_table] if isinstance(landing_table, str) else list(landing_table)
    landed = [spark.readStream.schema(table_schema(t, period_cols)).parquet(f"{star_dir.rstrip('/')}/{t}")
              .select(*period_cols) for t in tables]
    stream = reduce(DataFrame.unionAll, landed)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        refresh_months(load_star(spark, star_dir), batch, out_dir, period_cols=period_cols)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
