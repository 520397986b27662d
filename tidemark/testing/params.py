"""Parameters of the test fixture (FIXTURES.md §3).

The analytics' production constants (bulk threshold, repair patterns, alert
thresholds) select nothing on the synthetic tables, so the registered queries
use these instead; the store-source list is the library default.
"""

from tidemark.operators.alerts import AlertThresholds
from tidemark.operators.orders import RepairPatterns
from tidemark.plans.periods import Period

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

CUR = Period("20240116", "20240130")
PREV = Period("20240101", "20240114")  # 20240115 is a gap day
CHANGED = ("20240108", "20240122")  # days from which the changing table has other columns and types
BULK_MIN = 400_000
PATTERNS = RepairPatterns(upper_pattern="PRO.O", name_pattern="ring|bolt|gear|rod|widget")
THRESHOLDS = AlertThresholds(
    total_revenue_pct=0.1, product_revenue=2_000_000, channel_revenue=3_000_000, channel_sessions=20,
    demographic_revenue=5_000_000, demographic_sessions=15, bulk_revenue_pct=2.0, bulk_revenue_abs=5_000_000,
    region_revenue=4_000_000, conversion_pp=0.5)
