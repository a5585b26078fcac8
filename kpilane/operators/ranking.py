"""Exact RANK / DENSE_RANK that stays balanced at any scale.

``rank() OVER (PARTITION BY role, month ORDER BY score DESC)`` sends every row
of a partition key to one task.  Ranking contexts such as (role, month) have a
handful of keys whatever the data size, so one task would sort a third of the
workforce.  ``rank_by(method="range")`` computes the same numbers with bounded
tasks:

1. histogram: ``(keys, score) -> rows`` with a partial (map-side) aggregate, so
   a score shared by millions of rows becomes one row (several rank contexts
   over the same score are stacked into one histogram);
2. range-partition the histogram on ``(keys, score desc)`` (distinct keys, so
   the ranges are balanced) and pin the partition ids with a reliable
   checkpoint;
3. per (partition, key): rows and distinct scores ahead inside the partition
   (window over one range partition) plus totals per partition;
4. offsets: a running sum of the partition totals over partitions in order
   (at most one row per partition and key);
5. ``rank = 1 + offset + ahead``; ``dense_rank`` uses distinct-score counts;
6. join the per-score ranks back (AQE splits a hot score on the big side).

``method="cells"`` gives the same numbers without a stored job, so a ranked
view stays lazy: instead of pinned range partitions, a score falls into a cell by
a fixed monotone function of its value (:func:`score_cell`), so any two runs
agree on it.  The histogram's window runs per (key, cell), the running sum
of step 4 over the cells of a key.  Only cells that hold a score are rows, at most
``CELLS_PER_LOG`` for every e-fold of the scores' magnitude.  Filters on key columns
(a period, say) reach the scans of both sides of the join back.

``method="window"`` is the plain window (fine when every partition key is
small, and used by the tests as the reference for the range method).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpilane.operators.joins import join_null_safe
from kpilane.schemas import PERIOD_COLUMNS

RANK_TIES = ("rank", "dense")
CELLS_PER_LOG = 1 << 16
MAX_CANDIDATES = 10_000  # rows that rank_of_rows may broadcast


def _rank_fn(ties: str):
    if ties == "rank":
        return F.rank()
    if ties == "dense":
        return F.dense_rank()
    raise ValueError(f"ties must be one of {RANK_TIES}, got {ties!r}")


def rank_by(df: DataFrame, keys: Sequence[str], score: str, out_col: str,
            ties: str = "rank", method: str = "range", num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` (bigint) = RANK/DENSE_RANK of ``score`` DESC NULLS LAST within ``keys``."""
    return rank_many(df, {out_col: keys}, score, ties, method, num_partitions)


def rank_many(df: DataFrame, contexts: Mapping[str, Sequence[str]], score: str, ties: str = "rank",
              method: str = "range", num_partitions: int | None = None) -> DataFrame:
    """Add one rank column per ``{out_col: keys}`` context, all over the same ``score``.

    With ``method="range"`` every context shares one histogram, one range
    partitioning and one checkpoint (the contexts are stacked, keyed by a
    context number and the context's keys as text).
    """
    if ties not in RANK_TIES:
        raise ValueError(f"ties must be one of {RANK_TIES}, got {ties!r}")
    if method == "window":
        out = df
        for col, keys in contexts.items():
            w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last())
            out = out.withColumn(col, _rank_fn(ties).over(w).cast("bigint"))
        return out
    if method == "cells":
        out = df
        for col, keys in contexts.items():
            out = _join_rows(out, cell_ranks(df, keys, score, col, ties), [*keys, score])
        return out
    if method != "range":
        raise ValueError(f"method must be 'range', 'cells' or 'window', got {method!r}")
    # the histogram and the join back on the score both read the rows: store them once
    df = df.checkpoint(eager=True)
    tables = rank_tables(df, contexts, score, ties, num_partitions)
    out = df
    for col, keys in contexts.items():
        out = join_null_safe(out, tables[col], [*keys, score], "inner")
    return out


def score_cell(score: str) -> Column:
    """A whole number that never falls as the score rises; NULL for NULL, NaN with the highest.

    ``log1p`` is semi-monotonic, so rounding can put two neighbouring scores in one cell but never swap them.
    """
    s = F.col(score).cast("double")
    size = F.floor(F.log1p(F.abs(s)) * F.lit(float(CELLS_PER_LOG)))
    return (F.when(s.isNull(), F.lit(None).cast("bigint")).when(F.isnan(s), F.lit((1 << 63) - 1))
            .when(s < 0, -size).otherwise(size))


def cell_ranks(df: DataFrame, keys: Sequence[str], score: str, out_col: str, ties: str = "rank") -> DataFrame:
    """``(keys.., score, out_col)`` for every distinct key and score; lazy."""
    keys = list(keys)
    hist = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", score_cell(score))
    measure = F.sum("_n") if ties == "rank" else F.count(F.lit(1))
    ahead = (Window.partitionBy(*keys, "_cell").orderBy(F.col(score).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    local = hist.select(*keys, score, "_cell", F.coalesce(measure.over(ahead), F.lit(0)).alias("_ahead"))
    before = (Window.partitionBy(*keys).orderBy(F.col("_cell").desc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (hist.groupBy(*keys, "_cell").agg(measure.alias("_in_cell"))
               .select(*keys, "_cell", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_before")))
    return _join_rows(local, offsets, [*keys, "_cell"]).select(
        *keys, score, (F.lit(1) + F.col("_before") + F.col("_ahead")).cast("bigint").alias(out_col))


def _join_rows(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row with its (one) row of the table, NULL-safe; the periods of scored rows are never
    NULL and meet by plain equality, which is what the optimizer infers filters through."""
    renamed = table.withColumnsRenamed({k: f"__r_{k}" for k in on})
    same = [F.col(k) == F.col(f"__r_{k}") if k in PERIOD_COLUMNS else F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on]
    return rows.join(renamed, same, "left").drop(*[f"__r_{k}" for k in on])


def rank_tables(df: DataFrame, contexts: Mapping[str, Sequence[str]], score: str, ties: str = "rank",
                num_partitions: int | None = None) -> dict[str, DataFrame]:
    """Per context: ``(keys.., score, out_col)`` for every distinct key and score.

    The stacked histogram carries keys as text; the (small) rank table casts
    them back to the input's types, so the join back is on the native columns.
    """
    pick = "_rank" if ties == "rank" else "_dense"
    table = score_rank_table(df, list(contexts.values()), score, num_partitions)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for i, (col, keys) in enumerate(contexts.items()):
        t = table.filter(F.col("_ctx") == F.lit(i))
        out[col] = t.select(*[F.col(f"_k{j}").cast(types[k]).alias(k) for j, k in enumerate(keys)], score,
                            F.col(pick).alias(col))
    return out


def range_histogram(df: DataFrame, contexts: Sequence[Sequence[str]], score: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Steps 1-2: the stacked ``(_ctx, _k.., score) -> _n`` histogram, range-partitioned
    on ``(_ctx, _k.., score desc)`` with its partition id ``_pid`` pinned by a
    reliable checkpoint.  ``num_partitions`` fixes the range count; by default it
    follows ``spark.sql.shuffle.partitions`` and AQE's partition sizing."""
    width = max(len(k) for k in contexts)
    kcols = [f"_k{j}" for j in range(width)]

    # stack the contexts row-wise: one (context, keys) entry per context per row
    entries = F.array(*[
        F.struct(F.lit(i).alias("_ctx"),
                 *[(F.col(keys[j]).cast("string") if j < len(keys) else F.lit(None).cast("string")).alias(f"_k{j}")
                   for j in range(width)])
        for i, keys in enumerate(contexts)])
    stacked = df.select(F.col(score), F.explode(entries).alias("_e")).select("_e.*", score)
    group = ["_ctx", *kcols]

    hist = stacked.groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(c).asc_nulls_first() for c in group] + [F.col(score).desc_nulls_last()]
    # Without an explicit count AQE may merge adjacent range partitions to its
    # advisory size; merged ranges stay in order, so the pinned ids stay valid.
    ranged = (hist.repartitionByRange(num_partitions, *order) if num_partitions
              else hist.repartitionByRange(*order))
    return ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def score_rank_table(df: DataFrame, contexts: Sequence[Sequence[str]], score: str,
                     num_partitions: int | None = None) -> DataFrame:
    """One row per context, distinct key and score with its ``_rank`` and ``_dense`` (bigint).

    Columns: ``_ctx`` (context number), ``_k0.._k{w-1}`` (the context's keys as
    text, NULL-padded), ``score``, ``_rank``, ``_dense``.
    """
    ranged = range_histogram(df, contexts, score, num_partitions)
    width = max(len(k) for k in contexts)
    group = ["_ctx", *[f"_k{j}" for j in range(width)]]

    ahead = (Window.partitionBy("_pid", *group).orderBy(F.col(score).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.select(
        "_pid", *group, score,
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead_rows"),
        F.coalesce(F.count(F.lit(1)).over(ahead), F.lit(0)).alias("_ahead_keys"),
    )

    totals = ranged.groupBy("_pid", *group).agg(
        F.sum("_n").alias("_part_rows"), F.count(F.lit(1)).alias("_part_keys"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *group,
        F.coalesce(F.sum("_part_rows").over(before), F.lit(0)).alias("_off_rows"),
        F.coalesce(F.sum("_part_keys").over(before), F.lit(0)).alias("_off_keys"),
    )

    joined = join_null_safe(local, offsets, ["_pid", *group], "inner")
    return joined.select(
        *group, score,
        (F.lit(1) + F.col("_off_rows") + F.col("_ahead_rows")).cast("bigint").alias("_rank"),
        (F.lit(1) + F.col("_off_keys") + F.col("_ahead_keys")).cast("bigint").alias("_dense"),
    )


def rank_of_rows(candidates: DataFrame, population: DataFrame, contexts: Mapping[str, Sequence[str]],
                 score: str, id_cols: Sequence[str], ties: str = "rank",
                 at_most: int = MAX_CANDIDATES) -> DataFrame:
    """RANK/DENSE_RANK of a few ``candidates`` rows within ``population``, per context.

    ``rank = 1 + #rows of the same keys whose score comes strictly first``
    (DESC NULLS LAST); ``dense`` counts distinct such scores.  The candidates
    are ``at_most`` rows (itself at most ``MAX_CANDIDATES``), e.g. the output of a ``limit``;
    the job fails if there are more.  They are
    broadcast and joined on the keys all contexts share, so the population is
    scanned once, never shuffled by key, and each row meets only the
    candidates of its shared keys.  ``id_cols`` identify a candidate row.
    """
    if not 0 < at_most <= MAX_CANDIDATES:
        raise ValueError(f"at_most must lie between 1 and {MAX_CANDIDATES}, got {at_most}")
    if ties not in RANK_TIES:
        raise ValueError(f"ties must be one of {RANK_TIES}, got {ties!r}")
    id_cols = list(id_cols)
    shared = [k for k in next(iter(contexts.values())) if all(k in ks for ks in contexts.values())]
    if not shared:
        raise ValueError("rank contexts share no key; rank them one context at a time")
    used = sorted({k for ks in contexts.values() for k in ks})
    counted = candidates.limit(at_most + 1).agg(F.count(F.lit(1)).alias("n")).scalar()
    guard = F.when(counted <= at_most, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"more than {at_most} candidates to rank")).cast("boolean"))
    cand = F.broadcast(candidates.filter(guard).limit(at_most).select(
        *[F.col(c).alias(f"_id_{c}") for c in id_cols], *[F.col(k).alias(f"_c_{k}") for k in used],
        F.col(score).alias("_c_score")))
    pop = population.select(*used, F.col(score).alias("_p_score"))
    first = F.col("_p_score").isNotNull() & (F.col("_c_score").isNull() | (F.col("_p_score") > F.col("_c_score")))
    joined = pop.join(cand, [pop[k].eqNullSafe(F.col(f"_c_{k}")) for k in shared], "inner").filter(first)
    counts = []
    for col, keys in contexts.items():
        same = first
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        if ties == "rank":
            counts.append(F.count_if(same).alias(col))
        else:
            counts.append(F.count_distinct(F.when(same, F.col("_p_score"))).alias(col))
    ahead = joined.groupBy(*[F.col(f"_id_{c}").alias(c) for c in id_cols]).agg(*counts)
    out = candidates.join(ahead, id_cols, "left")
    return out.select(*[c for c in candidates.columns],
                      *[(F.lit(1) + F.coalesce(F.col(col), F.lit(0))).cast("bigint").alias(col) for col in contexts])


def top_n_by_rank(df: DataFrame, keys: Sequence[str], score: str, n: int, out_col: str = "rank",
                  ties: str = "rank") -> DataFrame:
    """Rows whose RANK within ``keys`` is at most ``n`` (leaderboards).

    ``rank() <= n`` is planned with a partial ``WindowGroupLimit`` before the
    shuffle, so each task forwards at most ``n`` rows (plus ties) per key and a
    huge partition key never reaches one task whole.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last())
    ranked = df.withColumn(out_col, _rank_fn(ties).over(w))
    return ranked.filter(F.col(out_col) <= F.lit(n)).withColumn(out_col, F.col(out_col).cast("bigint"))
