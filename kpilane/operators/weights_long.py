"""Weights keyed by the long-view pillar label (the pillar registry as a relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.schemas import PILLARS


def pillar_labels(spark) -> DataFrame:
    """The pillar registry: key, long-view label and weight-table metric name."""
    rows = [(p.key, p.long_label, p.weight_metric) for p in PILLARS]
    return spark.createDataFrame(rows, "pillar_key string, pillar_name string, metric_name string")


def weights_long(weights: DataFrame) -> DataFrame:
    """role, pillar_key, pillar_name, metric_name, weight_pct (MAX over duplicate rows)."""
    labels = F.broadcast(pillar_labels(weights.sparkSession))
    per_metric = weights.groupBy("role", "metric_name").agg(F.max("weight_pct").alias("weight_pct"))
    return per_metric.join(labels, "metric_name").select(
        "role", "pillar_key", "pillar_name", "metric_name", "weight_pct")
