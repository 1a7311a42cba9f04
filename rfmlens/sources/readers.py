"""Readers (SRC-1..8).

* Month-partitioned facts are read once for all months; the month is a
  partition column (Hive layout ``.../month=202101/``), so a month list becomes
  ``PartitionFilters`` instead of one scan per month in a driver loop.
* Legacy layouts with the month only in a path segment (``.../202101/x.parquet``)
  are read with a glob and get the month from ``_metadata.file_path``.
* Months written by different producers may hold a column as text, double or decimal: one inferred schema then fails on the first
  file of another type. With a declared schema, files are grouped by the schema of their footers, each group is read with
  its own types and conformed, and the groups are united.
* CSV is read with a declared schema; no inference pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from rfmlens.functions.dates import month_token


def read_tree(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """SRC-1: every Parquet file below ``root`` (any depth)."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return df if schema is None else conform(df, schema, root)


def read_monthly(spark: SparkSession, root: str, months: Sequence[str] | None = None,
                 schema: StructType | None = None, month_col: str = "month") -> DataFrame:
    """SRC-2/3/4/8: a ``month=yyyyMM`` partitioned table, pruned to ``months``."""
    if schema is not None:
        return read_conformed(spark, root, schema, months, month_col)
    # Partition discovery types 202101 as an integer; keep the yyyyMM text.
    df = spark.read.parquet(root).withColumn(month_col, F.col(month_col).cast("string"))
    if months is not None:   # an empty list selects nothing
        df = df.where(F.col(month_col).isin([str(m) for m in months]))
    return df


def parquet_files(spark: SparkSession, root: str) -> list[str]:
    """Parquet files below ``root`` (from the file index, nothing is read); none where the folder is missing, any other fault raises."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        return sorted(listing.load(root).inputFiles())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def schema_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[StructType, list[str]]]:
    """Files of equal types: (schema without partition columns, paths to read).

    Footers are merged by one Spark job for as many files as agree: all at once, else folder by folder, else file by file.
    """
    def merged(paths: Sequence[str]) -> StructType | None:
        try:
            return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths).schema
        except (PySparkException, Py4JJavaError) as e:
            if "MERGE" not in str(e).upper():
                raise
            return None

    if not files:
        return []
    folders: dict[str, list[str]] = {}
    for f in files:
        folders.setdefault(f.rsplit("/", 1)[0], []).append(f)
    whole = merged(sorted(folders))
    if whole is not None:
        return [(whole, list(files))]

    def of(folder: str) -> list[tuple[StructType, list[str]]]:
        own = merged([folder])
        return [(own, folders[folder])] if own is not None else [(merged([f]), [f]) for f in folders[folder]]

    with ThreadPoolExecutor(max_workers=8) as pool:
        found = [g for gs in pool.map(of, sorted(folders)) for g in gs]
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for schema, paths in found:
        groups.setdefault(schema.json(), (schema, []))[1].extend(paths)
    return list(groups.values())


def read_conformed(spark: SparkSession, root: str, schema: StructType, months: Sequence[str] | None = None,
                   month_col: str = "month", files: Sequence[str] | None = None) -> DataFrame:
    """A ``month=yyyyMM`` table with the names and types of ``schema``, whatever types a month was written with.

    A column or field that a file's schema lacks raises. Only files of ``months`` are read; ``files`` saves the listing.
    """
    token = f"/{month_col}="
    wanted = None if months is None else {str(m) for m in months}
    found = parquet_files(spark, root) if files is None else files
    files = [f for f in found if wanted is None or f.rsplit(token, 1)[-1].split("/")[0] in wanted]
    by_partition = any(token in f for f in files)
    parts = []
    for own, paths in schema_groups(spark, files):
        month = StructField(month_col, StringType())
        full = StructType([f for f in own.fields if f.name != month_col] + [month]) if by_partition else own
        parts.append(conform(spark.read.schema(full).option("basePath", root).parquet(*paths), schema, root))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def read_month_dirs(spark: SparkSession, root: str, months: Sequence[str],
                    schema: StructType | None = None, month_col: str = "month",
                    dir_prefix: str = "") -> DataFrame:
    """SRC-2 legacy layout: ``root/<prefix><yyyyMM>/*.parquet`` with a brace glob, one scan.

    SRC-7/FN-5/6: the month comes from the file path of each row (the glob
    reads files directly, so no partition column is discovered).
    """
    pattern = f"{root.rstrip('/')}/{dir_prefix}{{{','.join(months)}}}/*.parquet"
    df = spark.read.parquet(pattern)
    token = month_token(F.col("_metadata.file_path"))
    if schema is None:
        return df.withColumn(month_col, token)
    return conform(df.select("*", token.alias(month_col)), StructType(
        [*[f for f in schema.fields if f.name != month_col], StructField(month_col, StringType())]), root)


def with_source_file(df: DataFrame, name: str = "filename") -> DataFrame:
    """SRC-7: lineage column with the file each row came from."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def read_csv_by_name(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC-5: the columns of ``schema`` from a CSV with a header, by name.

    A declared schema binds CSV columns by position, whatever the header
    says. So the file is read as text, the declared names are selected (in any
    order, from a wider file) and cast; a missing name raises.
    """
    raw = spark.read.option("header", "true").csv(path)
    require_columns(raw, schema.names, path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def require_columns(df: DataFrame, names: Sequence[str], where: str) -> None:
    """Raise unless every name is a column of ``df``."""
    have = {c.lower() for c in df.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise ValueError(f"{where} lacks the columns {', '.join(missing)}")


def conform(df: DataFrame, schema: StructType, where: str = "the input") -> DataFrame:
    """The columns of ``schema`` by name, cast to its types (structs field by
    field); a missing column or field raises instead of reading as null."""
    require_columns(df, schema.names, where)
    return df.select(*[_conform(F.col(f"`{f.name}`"), df.schema[_own(df, f.name)].dataType, f, where) for f in schema.fields])


def _own(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def _conform(c: Column, have: DataType, want: StructField, where: str) -> Column:
    def cast(value: Column, h: DataType, w: DataType, name: str) -> Column:
        if isinstance(w, StructType) and isinstance(h, StructType):
            own = {f.name.lower(): f for f in h.fields}
            if missing := [f.name for f in w.fields if f.name.lower() not in own]:
                raise ValueError(f"{where}: {name} lacks the fields {', '.join(missing)}")
            made = F.struct(*[cast(value.getField(own[f.name.lower()].name), own[f.name.lower()].dataType, f.dataType, f"{name}.{f.name}").alias(f.name)
                              for f in w.fields])
            return F.when(value.isNotNull(), made)
        if isinstance(w, ArrayType) and isinstance(h, ArrayType):
            return F.transform(value, lambda x: cast(x, h.elementType, w.elementType, f"{name}[]"))
        return value if h == w else value.cast(w)
    return cast(c, have, want.dataType, want.name).alias(want.name)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | None = None,
                   header: bool = True) -> DataFrame:
    """SRC-5: CSV with a header; typed when a schema is given, else all strings.

    The schema binds by position: for files that this library wrote. Files
    from elsewhere are read with ``read_csv_by_name``.
    """
    reader = spark.read.option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def month_ranges(months: Sequence[str]) -> list[tuple[dt.date, dt.date]]:
    """Contiguous ``yyyyMM`` months merged into [start, end) date ranges."""
    starts = sorted(dt.date(int(m[:4]), int(m[4:6]), 1) for m in set(months))
    ranges: list[tuple[dt.date, dt.date]] = []
    for s in starts:
        e = dt.date(s.year + (s.month == 12), s.month % 12 + 1, 1)
        if ranges and ranges[-1][1] == s:
            ranges[-1] = (ranges[-1][0], e)
        else:
            ranges.append((s, e))
    return ranges


def months_predicate(ts: str | Column, months: Sequence[str]) -> Column:
    """SRC-2 on a table with a timestamp instead of a month partition.

    Range comparisons on the raw column (not ``date_format(ts)``), so the
    predicate reaches the Parquet scan as ``PushedFilters`` and row groups are
    skipped by their min/max statistics.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    pred = None
    for start, end in month_ranges(months):
        p = (c >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")) & \
            (c < F.lit(dt.datetime.combine(end, dt.time())).cast("timestamp_ntz"))
        pred = p if pred is None else (pred | p)
    return pred if pred is not None else F.lit(False)
