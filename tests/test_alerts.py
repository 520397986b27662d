from decimal import Decimal

from tidemark import AlertThresholds, change_alerts

SUMMARY = "type string, revenue decimal(38,2), bulk_revenue decimal(38,2), orders bigint, sessions bigint"
DEMO = ("demographic string, current_revenue decimal(38,2), revenue_change decimal(38,2), revenue_change_pct double, "
        "sessions_change bigint, sessions_change_pct double")


def test_rules_fire_with_rank_holes_and_unknown_positions(spark):
    summary = spark.createDataFrame([("Current", Decimal("110"), Decimal("0"), 10, 100),
                                     ("Previous", Decimal("100"), Decimal("0"), 10, 100)], SUMMARY)
    demo = spark.createDataFrame([
        ("Unknown / 20-29", Decimal("900"), Decimal("800"), None, 500, 10.0),
        ("Male / 20-29", Decimal("800"), Decimal("10"), 1.0, -300, -5.0),
        ("Female / 30-39", Decimal("700"), Decimal("600"), 50.0, 5, None),
        ("Male / Unknown", Decimal("600"), Decimal("-700"), -60.0, 1, 1.0),
        ("Female / 20-29", Decimal("500"), Decimal("-900"), None, 150, 2.0),
    ], DEMO)
    t = AlertThresholds(demographic_revenue=100, demographic_sessions=100)
    got = [(r.rule, r.rank, r.subject, r.direction, r.change, r.change_pct)
           for r in change_alerts(summary, demographics=demo, thresholds=t).collect()]
    assert ("total_revenue", None, "revenue", "up", 10.0, 10.0) in got
    rev = [g for g in got if g[0] == "demographic_revenue"]
    # positions before dropping 'Unknown' rows: 3 and 5 fire, 2 is below the threshold
    assert [(g[1], g[2]) for g in rev] == [(3, "Female / 30-39"), (5, "Female / 20-29")]
    assert rev[1][5] == 0.0  # NULL pct reads as 0
    ses = [(g[1], g[2], g[4]) for g in got if g[0] == "demographic_sessions"]
    assert ses == [(1, "Male / 20-29", -300.0), (2, "Female / 20-29", 150.0)]


def test_nothing_fires_gives_empty(spark):
    summary = spark.createDataFrame([("Current", Decimal("100"), Decimal("0"), 10, 100),
                                     ("Previous", Decimal("100"), Decimal("0"), 10, 100)], SUMMARY)
    assert change_alerts(summary).count() == 0
