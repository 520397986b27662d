"""Flatten once: named scalar columns over the nested events table.

Every operator selects only the columns it needs from this registry, so the
Parquet scan reads only those leaves (nested-field pruning) and the param
lookups are computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import MONEY
from tidemark.functions.params import param_int, param_str

# Parameter and user-property keys read by the analytics.
SESSION_ID_KEY = "ga_session_id"
SESSION_NUMBER_KEY = "ga_session_number"
SOURCE_KEY = "source"
GENDER_KEYS = ("u_gender", "gender", "sex", "user_gender")
AGE_KEYS = ("u_age", "age", "age_group", "user_age")


_FLAT = {
    "event_date": lambda: F.col("event_date"),
    "event_timestamp": lambda: F.col("event_timestamp"),
    "user_pseudo_id": lambda: F.col("user_pseudo_id"),
    "event_name": lambda: F.col("event_name"),
    "purchase_revenue": lambda: F.col("ecommerce.purchase_revenue").cast(MONEY),
    "transaction_id": lambda: F.col("ecommerce.transaction_id"),
    "sid": lambda: param_int("event_params", SESSION_ID_KEY),
    "s_num": lambda: param_int("event_params", SESSION_NUMBER_KEY),
    "param_source": lambda: param_str("event_params", SOURCE_KEY),
    "ts_source": lambda: F.col("traffic_source.source"),
    "ts_medium": lambda: F.col("traffic_source.medium"),
    "country": lambda: F.col("geo.country"),
    "city": lambda: F.col("geo.city"),
    "device": lambda: F.col("device.category"),
    "ep_gender": lambda: param_str("event_params", GENDER_KEYS),
    "up_gender": lambda: param_str("user_properties", GENDER_KEYS),
    "ep_age": lambda: param_str("event_params", AGE_KEYS),
    "up_age": lambda: param_str("user_properties", AGE_KEYS),
    "items": lambda: F.col("items"),
}
FLAT_NAMES = tuple(_FLAT)


def flat_column(name: str) -> Column:
    """The expression of one flat column over the nested events table."""
    try:
        return _FLAT[name]()
    except KeyError:
        raise KeyError(f"unknown flat column {name!r}; known: {sorted(_FLAT)}") from None


def item_fields(*fields: str, items: str = "items") -> Column:
    """``items`` narrowed to the named struct fields (``arrays_zip`` of the projected
    field arrays), so the Parquet scan reads only those leaves of the item struct."""
    return F.arrays_zip(*[F.col(f"{items}.{f}").alias(f) for f in fields])


def prepare(events: DataFrame, *names: str, **extra: Column) -> DataFrame:
    """Project ``events`` to the named flat columns plus ``extra`` expressions."""
    return events.select(*[flat_column(n).alias(n) for n in names],
                         *[c.alias(k) for k, c in extra.items()])
