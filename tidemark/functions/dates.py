"""Date helpers: ``yyyyMMdd`` parsing, Sunday-start weeks, month start, grains."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("daily", "weekly", "monthly")


def to_yyyymmdd(d: _dt.date | str) -> str:
    """Normalise a date or an ISO / ``yyyyMMdd`` string to ``yyyyMMdd``."""
    if isinstance(d, _dt.datetime):
        d = d.date()
    if isinstance(d, _dt.date):
        return d.strftime("%Y%m%d")
    s = str(d).strip()
    if len(s) == 8 and s.isdigit():
        _dt.datetime.strptime(s, "%Y%m%d")
        return s
    return _dt.date.fromisoformat(s).strftime("%Y%m%d")


def parse_yyyymmdd(c: str | Column, strict: bool = True) -> Column:
    """``yyyyMMdd`` text to DATE.  ``strict`` raises on bad text (ANSI); else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c, "yyyyMMdd") if strict else F.try_to_date(c, F.lit("yyyyMMdd"))


def week_start_sunday(d: Column) -> Column:
    """First day of the week containing ``d``, weeks starting on Sunday.

    ``date_trunc('week')`` starts weeks on Monday; ``dayofweek`` is 1 on Sunday.
    """
    return F.date_sub(d, F.dayofweek(d) - 1)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def grain_start(d: Column, grain: str) -> Column:
    """Bucket start date of ``d`` for a trend grain (daily / weekly / monthly)."""
    if grain == "daily":
        return d
    if grain == "weekly":
        return week_start_sunday(d)
    if grain == "monthly":
        return month_start(d)
    raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")
