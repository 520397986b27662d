"""String helpers with warehouse-style semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_ws(c: Column) -> Column:
    """Strip leading and trailing whitespace of every kind (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """``NULLIF(TRIM(COALESCE(c, '')), '')``."""
    return F.nullif(trim_ws(F.coalesce(c, F.lit(""))), F.lit(""))
