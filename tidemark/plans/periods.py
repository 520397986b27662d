"""Period pairs and period tagging (current vs comparison).

Periods are closed ``[start, end]`` date ranges kept as ``yyyyMMdd`` strings,
so every test on ``event_date`` compares the partition column with string
literals and becomes a ``PartitionFilters`` entry of the scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import to_yyyymmdd

CURRENT = "Current"
PREVIOUS = "Previous"


@dataclass(frozen=True)
class Period:
    start: str
    end: str

    def __init__(self, start: _dt.date | str, end: _dt.date | str):
        s, e = to_yyyymmdd(start), to_yyyymmdd(end)
        if s > e:
            raise ValueError(f"period start {s} is after end {e}")
        object.__setattr__(self, "start", s)
        object.__setattr__(self, "end", e)

    def contains(self, date_col: str | Column = "event_date") -> Column:
        c = F.col(date_col) if isinstance(date_col, str) else date_col
        return c.between(F.lit(self.start), F.lit(self.end))


def covering(cur: Period, prev: Period) -> Period:
    """``min(starts) .. max(ends)``: one range over both periods, gap days included."""
    return Period(min(cur.start, prev.start), max(cur.end, prev.end))


def period_type(cur: Period, date_col: str | Column = "event_date") -> Column:
    """'Current' inside the current period, else 'Previous' (gap days included)."""
    return F.when(cur.contains(date_col), F.lit(CURRENT)).otherwise(F.lit(PREVIOUS))
