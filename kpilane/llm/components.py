"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import require_checkpoint_dir, shuffle_partitions


def _pairs(links: DataFrame, first: tuple[str, str], second: tuple[str, str], into: tuple[str, str]) -> DataFrame:
    """Two rows for each link, made in the row: a union would plan and run everything behind the links twice."""
    rows = [F.struct(*[F.col(c).alias(name) for c, name in zip(pair, into)]) for pair in (first, second)]
    return links.select(F.explode(F.array(*rows)).alias("pair")).select(*[F.col("pair")[name].alias(name) for name in into])


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v) links with the least neighbour of u (or u itself); aggregate and join, so a hub is no single group."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u"), F.least("u", "least").alias("least"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = _pairs(links, ("u", "v"), ("v", "u"), ("u", "v"))
    return (_with_least(both).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v"))


def _small_star(links: DataFrame) -> DataFrame:
    starred = _with_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return _pairs(starred, ("v", "least"), ("u", "least"), ("u", "v")).filter("u <> v").distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = _pairs(links.withColumns({"out": F.lit(1), "into": F.lit(0)}), ("u", "out"), ("v", "into"), ("node", "out")) \
        .withColumn("into", 1 - F.col("out"))
    return (ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
            .filter("out > 1 or (out = 1 and into = 1)").isEmpty())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (columns u and v); the component is its least node."""
    require_checkpoint_dir(links.sparkSession)
    few = -(-shuffle_partitions(links.sparkSession) // 8)  # links are far smaller than the texts behind them
    links = links.filter("u <> v").checkpoint()
    while True:
        links = _small_star(_large_star(links)).coalesce(few).checkpoint()
        if _all_stars(links):
            break
    return _pairs(links, ("u", "v"), ("v", "v"), ("node", "component")).dropDuplicates(["node"])
