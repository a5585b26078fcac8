"""Star I/O: typed CSV extracts, Parquet folders and per-view exports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kpilane.functions.labels import parse_integer, parse_real
from kpilane.schemas import (INTEGER_COLUMNS, PERIOD_COLUMNS, PERIOD_TABLES, ROLE_WEIGHTS, SCHEMAS, STAR_TABLES,
                             period_columns, table_schema)


def role_weights_frame(spark: SparkSession) -> DataFrame:
    """The fixed role x pillar weights as a DataFrame (11 rows of configuration)."""
    return spark.createDataFrame(list(ROLE_WEIGHTS), SCHEMAS["dim_role_weights"])


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.options(header=True, encoding="UTF-8", multiLine=multi_line, escape='"')


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of the extracts holds a line break: then a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, names: the header of every extract, cell by cell.

    Only the first split of each file is looked at; its first line comes first in its task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), "value").filter("_start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "_line").alias("header"))
    # an unquoted name, or a quoted one with its quotes doubled
    cells = F.regexp_extract_all(F.regexp_replace("header", "^\ufeff|\r$", ""),
                                 F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^",]*)'), F.lit(1))
    names = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return first.select("file", names.alias("names"))


def read_csv_typed(spark: SparkSession, path: str, table: str,
                   numeric_columns: set[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """Read header CSV extracts the way the scorecard loader types them.

    Every cell is read as text.  Columns in ``numeric_columns`` (default: the
    numeric columns of the table's schema) become integers when their name is
    an integer column (``'3.7' -> 3``), otherwise doubles; blanks become NULL
    and malformed numbers fail the job (ANSI casts).  Text columns keep an
    empty cell as ``''``; quotes are doubled inside a quoted cell, which may
    hold line breaks.  Cells go to columns by the names in their own file's header, so files
    may order their columns differently; a file that lacks a column, or has another, fails the
    job.  The result has the table's schema order when the header matches
    it, otherwise the first file's order.

    A file is read in splits, by many tasks, unless a quoted cell holds a line break;
    then a file is one task.  ``multi_line`` says so where it is known; by default
    the lines are looked through once.
    """
    header = _csv(spark, True).option("inferSchema", False).csv(path).columns
    schema = table_schema(table, header)
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    reader = _csv(spark, multi_line).option("mode", "FAILFAST")
    headers = csv_headers(spark, path)
    if headers.filter(F.col("names") != F.array(*map(F.lit, header))).isEmpty():
        raw = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    else:  # by place, then by the file's own names (a row for each file)
        by_place = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
        cells = reader.schema(by_place).csv(path).select(
            F.col("_metadata.file_path").alias("file"), F.array(*by_place.fieldNames()).alias("cells"))
        wrong = F.concat(F.lit("extract with other columns than the first one's: "), F.col("file"))
        named = headers.select("file", F.when(
            F.sort_array("names") == F.array(*map(F.lit, sorted(header))), F.col("names"))
            .otherwise(F.raise_error(wrong)).alias("names"))
        raw = cells.join(named, "file").select(
            *[F.element_at("cells", F.array_position("names", F.lit(c)).cast("int")).alias(c) for c in header])
    if numeric_columns is None:
        numeric_columns = {f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    cols = []
    for c in header:
        if c in numeric_columns:
            if c in INTEGER_COLUMNS:
                target = schema[c].dataType if c in schema.fieldNames() else T.LongType()
                cols.append(parse_integer(c).cast(target).alias(c))
            else:
                cols.append(parse_real(c).alias(c))
        else:
            cols.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    out = raw.select(*cols)
    if set(header) == set(schema.fieldNames()):
        out = out.select(*schema.fieldNames())
    return out


def read_role_weights(spark: SparkSession, path: str, expected_total: float = 100.0) -> DataFrame:
    """The stored role x pillar weights, typed and checked while they are read.

    A role and metric given twice, or a role whose weights don't add up, fails the job that reads them.
    """
    weights = read_csv_typed(spark, path, "dim_role_weights")
    role = Window.partitionBy("role")  # a configuration: a few rows for each role
    twice = F.count(F.lit(1)).over(Window.partitionBy("role", "metric_name")) > 1
    off = F.abs(F.sum("weight_pct").over(role) - F.lit(expected_total)) > 1e-9
    fault = (F.when(twice, F.concat(F.lit("role weight given twice: "), "role", F.lit(", "), "metric_name"))
             .when(off, F.concat(F.lit("role weights don't add up: "), "role")))
    checked = weights.withColumn("_fault", fault)
    return checked.select("role", "metric_name", F.when(F.col("_fault").isNull(), F.col("weight_pct"))
                          .otherwise(F.raise_error(F.col("_fault")).cast("double")).alias("weight_pct"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header CSV extract with a fixed column order (one folder of part files); text is kept as it is."""
    out = df.select(*(columns or df.columns))
    out.write.mode("overwrite").options(header=True, encoding="UTF-8", escape='"', ignoreLeadingWhiteSpace=False,
                                        ignoreTrailingWhiteSpace=False).csv(path)


def load_star(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Load the seven tables from ``folder/<table>`` (Parquet or CSV extracts).

    A fact stored with a ``year`` keeps it. Facts stored by period are read by period: a filter on ``year`` or
    ``month_number`` reaches the folders.
    """
    folder = folder.rstrip("/")
    if fmt == "parquet":
        stored = {t: spark.read.parquet(f"{folder}/{t}") for t in STAR_TABLES}
        out = {}
        for t, df in stored.items():
            fields, types = table_schema(t, df.columns), dict(df.dtypes)
            # a column of the right type stays bare: a cast would keep filters from the folders
            out[t] = df.select(*[F.col(f.name) if types[f.name] == f.dataType.simpleString()
                                 else F.col(f.name).cast(f.dataType) for f in fields])
        return out
    if fmt == "csv":
        star = {t: read_csv_typed(spark, f"{folder}/{t}", t) for t in STAR_TABLES if t != "dim_role_weights"}
        return star | {"dim_role_weights": read_role_weights(spark, f"{folder}/dim_role_weights")}
    raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")


def write_periods(df: DataFrame, path: str, period: Sequence[str], dynamic: bool = False) -> None:
    """Write ``df`` in folders by period, each period in few files however many tasks made its rows.

    With ``dynamic=True`` only the periods that ``df`` has rows of are replaced; others stay as they are. A
    replayed write leaves the same rows.
    """
    writer = df.hint("rebalance", *period).write.mode("overwrite").partitionBy(*period)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def save_star(star: Mapping[str, DataFrame], folder: str, fmt: str = "parquet",
              concurrent: bool = True, by_period: bool = False) -> None:
    """Write each table, replacing what is there (drop-and-recreate semantics).

    The seven writes are independent jobs; with ``concurrent=True`` they are
    submitted from a small thread pool so the scheduler can run them side by side.
    ``by_period`` stores the facts in folders by their period (year and month, or month alone).
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")
    folder = folder.rstrip("/")

    def write(t: str) -> None:
        df = star[t].select(*table_schema(t, star[t].columns).fieldNames())
        period = period_columns(df)
        if fmt == "csv":
            write_csv(df, f"{folder}/{t}")
        elif by_period and period:
            write_periods(df, f"{folder}/{t}", period)
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{t}")

    _each(write, STAR_TABLES, concurrent)


def replace_periods(facts: Mapping[str, DataFrame], folder: str, concurrent: bool = True) -> None:
    """Replace in a star stored by period the periods that the given fact tables have rows of."""
    def write(t: str) -> None:
        df = facts[t].select(*table_schema(t, facts[t].columns).fieldNames())
        write_periods(df, f"{folder.rstrip('/')}/{t}", period_columns(df), dynamic=True)

    unknown = set(facts) - set(PERIOD_TABLES)
    if unknown:
        raise ValueError(f"not stored by period: {sorted(unknown)}")
    _each(write, facts, concurrent)


def _each(write: Callable[[str], None], tables: Iterable[str], concurrent: bool) -> None:
    tables = list(tables)
    if not concurrent or len(tables) < 2:
        for t in tables:
            write(t)
        return
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        for f in [pool.submit(write, t) for t in tables]:
            f.result()


def materialize_star(spark: SparkSession, star: Mapping[str, DataFrame], folder: str,
                     by_period: bool = False) -> dict[str, DataFrame]:
    """Write the seven tables once (Parquet) and return frames that read them.

    This is the load step of the scorecard: every view then reads compact,
    column-pruned Parquet instead of re-deriving the tables from raw data.
    ``folder`` must be on shared storage.
    """
    save_star(star, folder, by_period=by_period)
    schemas = {t: table_schema(t, star[t].columns) for t in STAR_TABLES}
    return {t: spark.read.schema(s).parquet(f"{folder.rstrip('/')}/{t}").select(*s.fieldNames())
            for t, s in schemas.items()}


def export_views(views: Mapping[str, DataFrame], folder: str,
                 partition_by: str | Sequence[str] | None = PERIOD_COLUMNS, dynamic: bool = False,
                 order_by: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """Write each view as Parquet for BI extracts, in folders by its period (the columns of
    ``partition_by`` that it has: year and month, or month alone).

    ``order_by`` gives a view its presentation order (e.g. employee, month):
    views stay unordered inside the plan and are sorted only at the sink.

    With ``dynamic=True`` a rerun for some periods replaces only those periods'
    folders (dynamic partition overwrite); the same month of another year stays.
    """
    folder = folder.rstrip("/")
    wanted = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
    paths = {}
    for name, df in views.items():
        path = f"{folder}/{name}"
        keys = (order_by or {}).get(name)
        period = [c for c in wanted if c in df.columns]
        if keys:
            # presentation order (the views' ORDER BY), applied only here at the
            # sink; the partition columns lead so the writer keeps the order
            df = df.orderBy(*period, *[k for k in keys if k not in period])
        w = df.write.mode("overwrite")
        if period:
            w = w.partitionBy(*period)
            if dynamic:
                w = w.option("partitionOverwriteMode", "dynamic")
        w.parquet(path)
        paths[name] = path
    return paths


def read_ordered(spark: SparkSession, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """An export in its stored order: every row with its ``position`` (from 1) in its folder.

    Files of an ordered export follow each other by name, rows in a file by their index, so a position is the
    row's index plus the rows of the files before: a sum over files, not over rows.
    """
    folder = list(partition_by)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"),
                                           F.col("_metadata.row_index").alias("_row"))
    before = Window.partitionBy(*folder).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(*folder, "_file").agg(F.count(F.lit(1)).alias("_rows")).select(
        *folder, "_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (rows.join(files, [*folder, "_file"])
            .withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before"))
