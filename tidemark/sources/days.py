"""Tables of one folder a day: which days there are, what their files look like, and one schema for all.

Two layouts: ``partitions`` (``event_date=yyyyMMdd``) and ``shards`` (one table
a day, ``events_yyyyMMdd``).  Exports change: amounts go from DOUBLE to
DECIMAL, counts from INT to BIGINT, columns come late.  Days of equal schema
form a group, read by one scan of only that group's folders; groups differ in
casts and in the columns that are NULL, and are put together by a union, so
date filters and column pruning still reach every scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arith import MONEY
from tidemark.plans.periods import Period

DATE = "event_date"
PARTITIONS, SHARDS = "partitions", "shards"
#: Folders whose files are looked at together (one footer each).
_LOOKS = 16

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_AMOUNT = (T.DecimalType, T.DoubleType, T.FloatType, *_WHOLE)

Found = list[tuple[str, T.DataType]]


def folder_name(layout: str, prefix: str) -> str:
    if layout not in (PARTITIONS, SHARDS):
        raise ValueError(f"unknown layout {layout!r}; expected {PARTITIONS} or {SHARDS}")
    return f"{DATE}=" if layout == PARTITIONS else prefix


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def day_folders(spark: SparkSession, path: str, layout: str = PARTITIONS, prefix: str = "events_",
                period: Period | None = None) -> dict[str, str]:
    """Folder of each day (of ``period``) in order; names that are no day, such as intraday tables, are passed over."""
    root, fs = hadoop_path(spark, path)
    name = re.compile(re.escape(folder_name(layout, prefix)) + r"(\d{8})")
    found = {m[1]: s.getPath().toString() for s in fs.listStatus(root)
             if s.isDirectory() and (m := name.fullmatch(s.getPath().getName()))}
    return {d: found[d] for d in sorted(found) if period is None or period.start <= d <= period.end}


def _schemas(spark: SparkSession, folders: dict[str, str]) -> dict[str, T.StructType]:
    """The schema of one file of each day; a day without files is left out."""
    def look(item: tuple[str, str]) -> tuple[str, T.StructType] | None:
        day, folder = item
        p, fs = hadoop_path(spark, folder)
        files = any(s.isFile() and not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))
        return (day, spark.read.parquet(folder).schema) if files else None

    with ThreadPoolExecutor(_LOOKS) as pool:
        return dict(filter(None, pool.map(inheritable_thread_target(spark)(look), folders.items())))


def common_type(want: T.DataType, found: Found, path: str, missing: list[str]) -> T.DataType:
    """``want`` with amounts of the type that all days have, or DECIMAL(22,6) where days differ.

    Columns that no day has are added to ``missing``; a type that cannot stand
    for the wanted one is an error that names the first day with it.
    """
    def fits(kinds: tuple[type, ...]) -> None:
        for day, kind in found:
            if not isinstance(kind, kinds):
                raise ValueError(f"{path}: {kind.simpleString()} instead of {want.simpleString()}" + (f" on {day}" if day else ""))

    if isinstance(want, T.ArrayType):
        fits((T.ArrayType,))
        return T.ArrayType(common_type(want.elementType, [(d, t.elementType) for d, t in found], path, missing))
    if isinstance(want, T.StructType):
        fits((T.StructType,))
        fields = []
        for f in want.fields:
            name = f"{path}.{f.name}".lstrip(".")
            there = [(d, t[f.name].dataType) for d, t in found if f.name in t.names]
            if there:
                fields.append(T.StructField(f.name, common_type(f.dataType, there, name, missing)))
            else:
                missing.append(name)
        return T.StructType(fields)
    if isinstance(want, T.DecimalType):
        fits(_AMOUNT)
        kinds = {t for _, t in found}
        return found[0][1] if len(kinds) == 1 else MONEY
    fits(_WHOLE if isinstance(want, T.LongType) else (type(want),))
    return want


def _own_part(common: T.DataType, own: T.DataType) -> T.DataType:
    """The fields of a day's type that are wanted: what its scan reads."""
    if isinstance(common, T.ArrayType):
        return T.ArrayType(_own_part(common.elementType, own.elementType))
    if isinstance(common, T.StructType):
        return T.StructType([T.StructField(f.name, _own_part(f.dataType, own[f.name].dataType))
                             for f in common.fields if f.name in own.names])
    return own


def _conform(c: Column, own: T.DataType, common: T.DataType) -> Column:
    """A column of a day as the common type; fields that the day lacks are NULL.

    A struct that lacks fields and is NULL becomes a struct of NULLs.
    """
    if own == common:
        return c
    if isinstance(common, T.StructType):
        return F.struct(*[(_conform(c[f.name], own[f.name].dataType, f.dataType) if f.name in own.names
                           else F.lit(None).cast(f.dataType)).alias(f.name) for f in common.fields])
    if isinstance(common, T.ArrayType):
        return F.transform(c, lambda x: _conform(x, own.elementType, common.elementType))
    return c.cast(common)


def _without_date(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != DATE])


def read_days(spark: SparkSession, path: str, folders: dict[str, str], want: T.StructType, layout: str = PARTITIONS,
              prefix: str = "events_") -> DataFrame:
    """The days' rows under one schema, ``want`` with the amounts as found, and the date of their folder."""
    schemas = {d: _without_date(s) for d, s in _schemas(spark, folders).items()}
    want = _without_date(want)
    if not schemas:
        return spark.createDataFrame([], T.StructType([*want.fields, T.StructField(DATE, T.StringType())]))
    missing: list[str] = []
    common = common_type(want, list(schemas.items()), "", missing)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for day, schema in schemas.items():
        own = _own_part(common, schema)
        groups.setdefault(own.json(), (own, []))[1].append(folders[day])
    parts = [_group(spark, path, own, common, paths, layout, prefix) for own, paths in groups.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _group(spark: SparkSession, path: str, own: T.StructType, common: T.StructType, paths: Sequence[str], layout: str,
           prefix: str) -> DataFrame:
    if layout == PARTITIONS:
        schema = T.StructType([*own.fields, T.StructField(DATE, T.StringType())])
        df = spark.read.schema(schema).option("basePath", path).parquet(*paths)
    else:
        # The path is constant for a file, so filters on the date leave out whole files.
        day = F.regexp_extract("_metadata.file_path", f"/{re.escape(prefix)}(\\d{{8}})/", 1)
        df = spark.read.schema(own).parquet(*paths).withColumn(DATE, day)
    cols = [(_conform(F.col(f.name), own[f.name].dataType, f.dataType) if f.name in own.names
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in common.fields]
    return df if own == common else df.select(*cols, DATE)


def put_days(spark: SparkSession, staged: str, path: str, layout: str = PARTITIONS, prefix: str = "events_",
             overwrite: bool = False, period: Period | None = None) -> None:
    """Give the day folders of a partitioned table under ``staged`` their places under ``path``.

    With ``overwrite`` they replace the folders of their days, and days of
    ``period`` that ``staged`` does not have are removed.
    """
    days, (root, fs) = day_folders(spark, staged), hadoop_path(spark, path)
    there = day_folders(spark, path, layout, prefix) if fs.exists(root) else {}
    name = folder_name(layout, prefix)
    if not overwrite and (taken := sorted(days.keys() & there.keys())):
        raise FileExistsError(f"{path} has {name}{taken[0]} already")
    gone = {d for d in there if period and period.start <= d <= period.end} - days.keys()
    for day in sorted(days.keys() & there.keys() | gone):
        fs.delete(hadoop_path(spark, there[day])[0], True)
    for day, folder in days.items():
        if not fs.rename(hadoop_path(spark, folder)[0], hadoop_path(spark, f"{path}/{name}{day}")[0]):
            raise OSError(f"cannot place {name}{day} in {path}")
