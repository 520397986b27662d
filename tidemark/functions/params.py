"""Key/value parameter lookup on repeated ``ARRAY<STRUCT<key, value STRUCT<…>>>`` fields.

The lookup returns the *first entry in array order* whose key matches (one key
or any key of a list), then one typed field of its value.  It is built from
``array_position`` over the projected key array (``params.key``) and ``get``
on the projected value array (``params.value.<field>``): both are plain
codegen'd expressions, no lambda, no explode, no join, and the Parquet scan
reads only the ``key`` and ``value.<field>`` leaves of the struct.  ``get``
returns NULL for a miss (also under ANSI mode), and keys need not be unique
(``map_from_entries`` would fail on repeated keys).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_key_position(array: str, keys: str | Iterable[str]) -> Column:
    """1-based position of the first entry whose key is in ``keys``; NULL when none (or NULL array)."""
    key_arr = F.col(f"{array}.key")
    key_list = [keys] if isinstance(keys, str) else list(keys)
    positions = [F.array_position(key_arr, F.lit(k)) for k in key_list]
    found = [F.when(p > 0, p) for p in positions]
    return found[0] if len(found) == 1 else F.least(*found)


def param_value(array: str, keys: str | Iterable[str], field: str) -> Column:
    """``value.<field>`` of the first entry whose key equals ``keys`` (or is one of them)."""
    return F.get(F.col(f"{array}.value.{field}"), first_key_position(array, keys) - 1)


def param_int(array: str, keys: str | Iterable[str]) -> Column:
    return param_value(array, keys, "int_value")


def param_str(array: str, keys: str | Iterable[str]) -> Column:
    return param_value(array, keys, "string_value")
