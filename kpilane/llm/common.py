"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id falls in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, where it isn't installed on them (once a session)."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_llm_package_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._llm_package_shipped = True


def require_checkpoint_dir(spark: SparkSession) -> None:
    """Lineage is cut in the folder the cluster names; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(conf)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder, and read from there.

    Unlike ``checkpoint()``, which runs the last stage a second time to save it, the rows are made once.
    """
    from kpilane.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores appended until no column has that name."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that a task's working memory stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


# --- word hashes -------------------------------------------------------------
# A word's 64-bit hash is sum(value[byte] * P**i) modulo 2**64, then mixed. All
# words of a batch are hashed from one running sum over its bytes.

_RANDOM = np.random.default_rng(20240229)
_MULTIPLIER = int(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1 | 4
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUES_LOWER = _BYTE_VALUES.copy()
_BYTE_VALUES_LOWER[65:91] = _BYTE_VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (a plain sort: several times as fast as numpy's ``unique`` on 64-bit hashes)."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OTHER_VALUES = np.random.default_rng(31415926).integers(1, 1 << 63, 256, dtype=np.uint64)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """The hash of every run of bytes ``raw[start:end]``; case counts. ``other``: a second, independent hash."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_OTHER_VALUES if other else _BYTE_VALUES)[raw] * up[:len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 word offsets of the documents).

    Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.
    """
    n = len(raw)
    word_byte = ~_SPACE[raw]
    # a word ends at a space or where its document ends
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word_byte[:-1]
    starts = np.flatnonzero(word_byte & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word_byte[1:]
    ends = np.flatnonzero(word_byte & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES_LOWER[raw] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)
