"""Exact top-k inner products over integer vectors, by descending length.

Components x become floor(64 * x). Vectors are dealt to blocks by length, the longest
first; ``LENGTH_CLASSES`` bounds from the data cut the lengths, and a class with many
vectors is split by a hash of a row number, so equal lengths (one vector copied many times) and
equal ids fill many blocks instead of one. Queries form small blocks of their own; equal
rows of one query are searched for once and carry their number.

Every query block first meets the block of the longest vectors, which gives each
query a threshold: its k-th best score there. Then it meets every block that can
still matter (product of the largest lengths at least the smallest threshold).
Within a pair of blocks the vectors are taken by descending length, up to where
Cauchy-Schwarz says that none can reach the threshold; the rest is rotated by the
eigenvectors of the second-moment matrix (the right singular vectors of the data),
and a first part of the rotated components gives a partial sum which, with the
product of the lengths of the residuals, bounds the score. Scores of the survivors
are exact integer inner products. All scores at or above the threshold stay, so
ties are settled by the smaller id.

Pairs of blocks are rows of an equi-join; the query set meets all rows in blocks.

Defined results: vectors that are null or hold a null or non-finite component take
no part; vectors of different length are compared as if padded with zeros; every row is a
candidate, also where its id or vector occurs again, but not of a query with its id; the rows
of one query id are ranked together, a candidate once for each of them, as in the SQL;
an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpilane.llm.common import require_checkpoint_dir

K = 20
QUERY_EVERY = 20
SCALE = 64
BLOCK = 2048
QUERY_BLOCK = 256
LENGTH_CLASSES = 32
LEADING = 0.9  # share of the squared lengths that the leading rotated components hold
EXACT = float(1 << 52)


def _pack(table: pa.Table) -> pa.Table:
    """A block of vectors as one row: ids, and components as integers of the least width that holds them."""
    table = table.sort_by([("length", "descending"), ("vec_id", "ascending")])
    lists = table["ints"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    x = np.zeros((len(sizes), dims), np.int64)
    x[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    payload = struct.pack("<qqq", len(x), dims, width) + table["vec_id"].to_numpy().astype("<i8").tobytes() \
        + x.astype(f"<i{width}").tobytes()
    if "times" in table.column_names:  # of queries
        payload += table["times"].to_numpy().astype("<i8").tobytes()
    return pa.table({"block": table["block"].slice(0, 1), "longest": table["length"].slice(0, 1),
                     "payload": pa.array([payload], pa.binary())})


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dims, width = struct.unpack_from("<qqq", payload)
    ids = np.frombuffer(payload, "<i8", n, 24)
    return ids, np.frombuffer(payload, f"<i{width}", n * dims, 24 + 8 * n).reshape(n, dims).astype(np.float64)


def _times(payload: bytes) -> np.ndarray:
    n = struct.unpack_from("<q", payload)[0]
    return np.frombuffer(payload, "<i8", n, len(payload) - 8 * n)


def _second_moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims, dims))
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        x = np.zeros((len(sizes), dims))
        x[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["cell", "v"])


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For every row, the places of its k best valid scores; of equal ones, those of the smaller ids."""
    for row in range(len(scores)):
        places = np.flatnonzero(valid[row])
        if len(places) > 4 * k:
            values = scores[row, places]
            places = places[values >= np.partition(values, len(values) - k)[len(values) - k]]
        yield places[np.lexsort((ids[places], -scores[row, places]))[:k]]


class Scorer:
    def __init__(self, dims: int, rotation: np.ndarray, leading: int, k: int) -> None:
        self.dims, self.rotation, self.leading, self.k = dims, rotation, leading, k

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        scores = q @ x.T
        if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(self.dims, 1) >= EXACT:
            return np.array(q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T)
        return scores

    def pair(self, queries: bytes, block: bytes, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, scores): the k best of the block that reach each query's floor."""
        query_ids, q = _unpack(queries)
        ids, x = _unpack(block)
        q, x = _padded(q, self.dims), _padded(x, self.dims)
        q_length, x_length = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)  # x by descending length
        slack = 1e-6
        # the lowest length that any query still needs
        need = np.where(floor > 0, floor / np.maximum(q_length, 1e-12), 0.0).min(initial=np.inf) * (1 - slack)
        n = int(np.searchsorted(-x_length, -need, side="right"))
        ids, x, x_length = ids[:n], x[:n], x_length[:n]
        if not n:
            return
        r = self.leading
        qr, xr = q @ self.rotation, x @ self.rotation
        bound = qr[:, :r] @ xr[:, :r].T
        bound += np.linalg.norm(qr[:, r:], axis=1)[:, None] * np.linalg.norm(xr[:, r:], axis=1)
        bound += slack * (q_length[:, None] * x_length + 1)
        alive = (bound >= floor[:, None]) & (query_ids[:, None] != ids)
        columns = np.flatnonzero(alive.any(axis=0))
        ids, alive = ids[columns], alive[:, columns]
        scores = self.exact(q, x[columns])
        alive &= scores >= floor[:, None]
        for row, places in enumerate(_best(scores, ids, alive, self.k)):
            if len(places):
                yield row, ids[places], scores[row, places]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = QUERY_EVERY,
          k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    require_checkpoint_dir(spark)
    finite = F.col(vector_col).isNotNull() & ~F.exists(
        vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = (vectors.filter(finite & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(vector_col, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long")).alias("ints"))
            .withColumn("length", F.sqrt(F.aggregate(
                "ints", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))))
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    cuts = [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)]
    dims, n_queries, bounds = rows.agg(F.max(F.size("ints")), F.count_if(is_query),
                                       F.percentile_approx("length", cuts, 1000)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return spark.createDataFrame([], schema)
    moments = (rows.select("ints").mapInArrow(lambda b: _second_moments(b, dims), "cell long, v double")
               .groupBy("cell").agg(F.sum("v").alias("v")).toArrow())
    matrix = np.zeros(dims * dims)
    matrix[moments["cell"].to_numpy()] = moments["v"].to_numpy()
    values, rotation = np.linalg.eigh(matrix.reshape(dims, dims))
    values, rotation = values[::-1].clip(0), rotation[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), 1e-12)
    scorer = spark.sparkContext.broadcast(Scorer(dims, rotation, int(min(dims, np.searchsorted(held, LEADING) + 1)), k))

    # blocks: length classes from the longest, each split evenly by a hash of the row's number
    known = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))])
    classed = rows.withColumn("class", F.size(F.filter(known, lambda b: b >= F.col("length"))))
    sizes = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}  # one row per class
    first, splits, n_blocks = [], [], 0
    for c in range(len(set(bounds)) + 1):
        first.append(n_blocks)
        splits.append(max(1, -(-sizes.get(c, 0) // BLOCK)))
        n_blocks += splits[-1] if c in sizes else 0
    share = F.pmod(F.xxhash64("row"), F.element_at(F.array(*map(F.lit, splits)), F.col("class") + 1))
    packed = "block long, longest double, payload binary"
    blocks = (classed.withColumn("row", F.monotonically_increasing_id())
              .withColumn("block", F.element_at(F.array(*map(F.lit, first)), F.col("class") + 1) + share)
              .select("block", "vec_id", "length", "ints").groupBy("block").applyInArrow(_pack, packed)
              .checkpoint())
    queries = (rows.filter(is_query).groupBy("vec_id", "length", "ints").agg(F.count("*").alias("times"))
               .withColumn("block", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(-(-n_queries // QUERY_BLOCK))))
               .select("block", "vec_id", "length", "ints", "times").groupBy("block").applyInArrow(_pack, packed)
               .toDF("query_block", "query_longest", "queries"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, longest, mine = (batch.column(j)[i].as_py() for j in range(3))
                n = struct.unpack_from("<q", mine)[0]
                floor = np.full(n, -np.inf)
                for row, _, scores in scorer.value.pair(mine, longest_block.value, floor.copy()):
                    if len(scores) == k:
                        floor[row] = float(scores[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([longest]), pa.array([mine], pa.binary()),
                     pa.array([floor.tobytes()], pa.binary()), pa.array([float(floor.min())])],
                    names=["query_block", "query_longest", "queries", "floor", "least"])

    # one block, about BLOCK vectors
    longest_block = spark.sparkContext.broadcast(blocks.orderBy("block").select("payload").first()[0])
    ready = (queries.mapInArrow(thresholds, "query_block long, query_longest double, queries binary, floor binary, "
                                            "least double").checkpoint())

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, floor, theirs = (batch.column(j)[i].as_py() for j in range(3))
                query_ids, _ = _unpack(mine)
                times = np.minimum(_times(mine), k)  # more than k equal rows of a query change nothing
                found = [(row, np.repeat(ids, times[row]), np.repeat(scores, times[row]))
                         for row, ids, scores in scorer.value.pair(mine, theirs, np.frombuffer(floor))]
                counts = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids[[f[0] for f in found]], counts) if found else [], pa.int64()),
                     pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
                     pa.array([int(s) for f in found for s in f[2]], pa.int64())], names=["query_id", "vec_id", "score"])

    pairs = (ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
             .join(blocks, "block")
             .filter(F.col("query_longest") * F.col("longest") * (1 + 1e-9) >= F.col("least")))
    found = (pairs.select("queries", "floor", "payload")
             .mapInArrow(matches, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle_sql() -> str:
    """All pairs, for DuckDB."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, least(len(q.ints), len(c.ints)) + 1),
      lambda i: q.ints[i] * c.ints[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}"""
