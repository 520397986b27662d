"""Exact money, ratio and percentage helpers.

Money is summed in DECIMAL (exact, independent of summation order) and cast to
DOUBLE only when it leaves an operator (``money``), the representation the
analytics' results have always had; any later arithmetic on such a value first
returns to DECIMAL (``exact``) with six decimals.  Ratios are
computed in DECIMAL with a wide scale (>= 12 digits), rounded half away from
zero, and only then cast to DOUBLE, so rounded values are exact and
engine-independent.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

#: Money inside operators: six decimals, for three-decimal currencies and fractional unit prices.  Sixteen
#: digits before the point leave quotients twelve decimals.
MONEY = DecimalType(22, 6)


def money(c: Column) -> Column:
    """Output form of an exact DECIMAL money value: DOUBLE (nearest to the exact cents)."""
    return c.cast("double")


def exact(c: Column) -> Column:
    """Money as DECIMAL(22,6) before arithmetic: a ``money`` DOUBLE gives back its six decimals up to about 10^9."""
    return c.cast(MONEY)


def ratio(num: Column, den: Column, scale_by: int = 1, digits: int = 1,
          zero_when_den_not_positive: bool = False) -> Column:
    """``round(num * scale_by / den, digits)`` as DOUBLE.

    NULL when ``den`` is 0 or NULL (SAFE_DIVIDE/NULLIF semantics); with
    ``zero_when_den_not_positive`` the result is 0.0 when ``den <= 0``.
    """
    n = num.cast(MONEY) * F.lit(scale_by)
    d = den.cast(MONEY)
    # A plain CASE guard (not NULLIF, which Spark rewrites into a common-expression
    # projection that keeps a later top-k from planning as TakeOrderedAndProject).
    out = F.when(d != 0, F.round(F.try_divide(n, d), digits).cast("double"))
    if zero_when_den_not_positive:
        out = F.when(den > 0, out).otherwise(F.lit(0.0))
    return out


def pct_change(cur: Column, prev: Column) -> Column:
    """``ROUND(SAFE_DIVIDE((cur - prev) * 100, NULLIF(prev, 0)), 1)``."""
    return ratio(cur - prev, prev, scale_by=100, digits=1)


def share_pct(part: Column, total: Column) -> Column:
    """``round(part / total * 100, 1)``, 0 when the total is not positive."""
    return ratio(part, total, scale_by=100, digits=1, zero_when_den_not_positive=True)


def threshold(value: float | int | Decimal, of: DataType) -> Column:
    """A lower bound as a literal of the column's own type, so that ``column >= bound`` is pushed to the scan.

    For DECIMAL columns it is rounded up to their scale, which keeps the same rows.
    """
    if not isinstance(of, DecimalType):
        return F.lit(float(value))
    exact_value = Decimal(str(value)).quantize(Decimal(1).scaleb(-of.scale), rounding=ROUND_CEILING)
    return F.lit(exact_value).cast(of)
