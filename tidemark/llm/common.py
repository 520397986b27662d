"""Shared helpers of the training-data operators: table access and shared scratch tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: Words of a text: runs of anything but these ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the driver's JVM ends.

    Inside ``temporary`` it is removed at the end of that block, unless it is ``lasting``.
    """
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = f"{sc.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    made = _made.get()
    if made is not None and not lasting:
        made.append(path)
    return path


def free(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: by then, results must be written to a ``lasting`` folder."""
    before = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(before)
        for path in made:
            free(spark, path)


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the tasks of its application can import this package (sent as a Python file from the shared folder)."""
    spark = df.sparkSession
    sc, root = spark.sparkContext, Path(__file__).parents[1]
    if sc.applicationId not in _shipped and root.is_dir():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'package', lasting=True)}/tidemark.zip")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(path.toString())
        _shipped.add(sc.applicationId)
    return df


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``docs`` written once with a unique number on each row, and the name of that column."""
    row = "__row"
    while row in map(str.lower, docs.columns):
        row += "_"
    return save(docs.withColumn(row, F.monotonically_increasing_id()), tag), row


#: Row numbers that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
MAX_BROADCAST_ROWS = 1 << 20


def without_rows(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows numbered in ``dropped`` (a column ``row``).

    The documents stay where they are while the numbers are at most
    ``MAX_BROADCAST_ROWS``; beyond, they are shuffled once.
    """
    dropped = save(dropped, "dropped-rows")
    few = dropped.count() <= MAX_BROADCAST_ROWS
    dropped = dropped.withColumnRenamed("row", row)
    return docs.join(F.broadcast(dropped) if few else dropped.hint("merge"), row, "left_anti")


def join_by_key(rows: DataFrame, of: DataFrame, key: str, total: int, how: str = "inner", small: Column | None = None) -> DataFrame:
    """``rows`` (``total`` at most) joined with ``of``, which has at most one row for a key, with ``n``, its number of rows.

    A key with more than a thousandth of all rows would fill one task; there
    are fewer than a thousand of these, so they are broadcast (but for those
    not ``small``, where keys have no fixed size), and the others shuffled.
    """
    hot = (F.col("n") * 1000 > total) & (F.lit(True) if small is None else small)
    few = F.broadcast(of.where(hot))
    cold = rows.join(F.broadcast(of.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(of.where(~hot), key, how)).drop("n")


def words(text: Column) -> Column:
    """Array of the words of a text; NULL gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")
