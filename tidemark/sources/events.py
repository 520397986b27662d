"""The nested events table: schema, reader, date-range scan and writer.

The table is stored as Parquet partitioned by ``event_date`` (``yyyyMMdd``
string); reading it with an explicit schema keeps ``event_date`` a STRING so
range filters on it prune partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.periods import Period
from tidemark.sources.days import PARTITIONS, SHARDS, common_type, day_folders, hadoop_path, put_days, read_days

_PARAM_VALUE = T.StructType([
    T.StructField("string_value", T.StringType()),
    T.StructField("int_value", T.LongType()),
])
PARAMS_TYPE = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", _PARAM_VALUE),
]))
ITEMS_TYPE = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_category", T.StringType()),
    T.StructField("price", T.DecimalType(18, 2)),
    T.StructField("quantity", T.LongType()),
]))

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("ecommerce", T.StructType([
        T.StructField("transaction_id", T.StringType()),
        T.StructField("purchase_revenue", T.DecimalType(18, 2)),
    ])),
    T.StructField("event_params", PARAMS_TYPE),
    T.StructField("user_properties", PARAMS_TYPE),
    T.StructField("items", ITEMS_TYPE),
    T.StructField("traffic_source", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("medium", T.StringType()),
    ])),
    T.StructField("geo", T.StructType([
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
    ])),
    T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
    T.StructField("event_date", T.StringType()),
])


def read_events(spark: SparkSession, path: str, period: Period | None = None, layout: str = PARTITIONS,
                prefix: str = "events_") -> DataFrame:
    """Read a Parquet events table with a folder a day; with ``period``, only its folders are listed.

    ``layout``: ``partitions`` (``event_date=yyyyMMdd``) or ``shards`` (``<prefix>yyyyMMdd``;
    the date comes from the folder).  Money may be DECIMAL of any scale or
    DOUBLE, and whole numbers of any width, also by days; a column that only
    some days have is NULL on the others.  A table that lacks a column on all
    days is an error.  One file of every day is looked at for its schema.
    """
    folders = day_folders(spark, path, layout, prefix, period)
    if folders or period or layout == SHARDS:
        return read_days(spark, path, folders, EVENTS_SCHEMA, layout, prefix)
    missing: list[str] = []
    schema = common_type(EVENTS_SCHEMA, [("", spark.read.parquet(path).schema)], "", missing)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return spark.read.schema(schema).parquet(path)


def revenue_type(events: DataFrame) -> T.DataType:
    """The stored type of an event's purchase revenue."""
    return events.schema["ecommerce"].dataType["purchase_revenue"].dataType


def scan(events: DataFrame, *periods: Period) -> DataFrame:
    """Events whose ``event_date`` lies in any of the given closed ranges."""
    if not periods:
        return events
    cond = periods[0].contains("event_date")
    for p in periods[1:]:
        cond = cond | p.contains("event_date")
    return events.where(cond)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists",
                 partitions: int | None = None) -> None:
    """Write events as Parquet partitioned by ``event_date``.

    An existing table is an error by default; ``append`` adds to it, and
    ``overwrite`` reloads the dates that ``events`` has (dynamic partition
    overwrite) and leaves every other date alone.

    Without ``partitions`` the rows are redistributed with the REBALANCE hint on
    ``event_date``: AQE sizes the write partitions from the real data (splitting
    a large day over many tasks, merging small ones) at its advisory partition
    size.  With ``partitions`` they are range-partitioned on (event_date,
    user_pseudo_id, event_timestamp) into that many tasks, so even one user
    with a huge share of a day is split by time.  Either way rows are sorted
    within each task by (event_date, user_pseudo_id, event_timestamp), which
    clusters each file by user for Parquet min/max statistics.
    """
    order = ["event_date", "user_pseudo_id", "event_timestamp"]
    if partitions is None:
        spread = events.hint("rebalance", "event_date")
    else:
        spread = events.repartitionByRange(partitions, *order)
    (spread.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date").parquet(path))


def write_shards(events: DataFrame, path: str, prefix: str = "events_", overwrite: bool = False,
                 partitions: int | None = None) -> None:
    """Write events as one Parquet folder ``<prefix>yyyyMMdd`` a day.

    One job writes all days beside their places, then each folder gets its
    name, so a day is there whole or not at all.  A day that exists is an error,
    unless ``overwrite`` replaces it.
    """
    spark, staged = events.sparkSession, f"{path}/_writing-{uuid.uuid4().hex}"
    try:
        write_events(events, staged, partitions=partitions)
        put_days(spark, staged, path, SHARDS, prefix, overwrite)
    finally:
        p, fs = hadoop_path(spark, staged)
        fs.delete(p, True)


#: Events of a bucket: one task reads a bucket, so larger tables get more of them.
ROWS_PER_BUCKET = 1 << 20


def _bucket_count(events: DataFrame, table: str, buckets: int, mode: str) -> int:
    """The least multiple of ``buckets`` that holds the events; a table that is added to keeps its number."""
    spark = events.sparkSession
    if mode == "append" and spark.catalog.tableExists(table):
        said = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
        has = int(said[0]["data_type"]) if said else buckets
        return buckets if has % buckets else has
    return buckets * max(1, -(-events.count() // (buckets * ROWS_PER_BUCKET)))


def write_bucketed(events: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """Write events as a catalog table at ``path``, partitioned by date and bucketed by user.

    ``spark.table(table)`` then gives events whose sessions lie together:
    first sources, channels and other figures by (user, session) need no shuffle of their rows.  All events of
    a user are read by one task, so this suits tables where no user holds a
    large share of the events; others keep ``write_events``.

    The table gets ``buckets`` buckets, or the least multiple of that with at
    most ``ROWS_PER_BUCKET`` events each on average, so a task that reads one
    needs no more memory on a larger table.  A bucket's day is the unit of
    writing (REBALANCE hint: AQE splits large ones over tasks and merges small
    ones), and Spark's writer sorts each task's rows by day, bucket, user and time.
    """
    n = _bucket_count(events, table, buckets, mode)
    bucket = F.pmod(F.hash("user_pseudo_id"), F.lit(n))  # as Spark numbers buckets
    (events.withColumn("_bucket", bucket).hint("rebalance", "event_date", "_bucket").drop("_bucket")
     .write.mode(mode).partitionBy("event_date").bucketBy(n, "user_pseudo_id").sortBy("user_pseudo_id", "event_timestamp")
     .option("path", path).format("parquet").saveAsTable(table))
