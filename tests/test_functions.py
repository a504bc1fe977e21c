"""Column expressions on hand-worked values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haulscope.functions import dates, numeric, risk, text
from haulscope.operators.enrich import shipment_view


def column(spark, values, kind, expression, rows):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return rows(df.select(expression("x")))


def test_tier_edges(spark, rows):
    found = column(spark, [0.67, 0.669, 0.34, 0.339, None], "double", risk.tier, rows)
    assert found == ["High", "Medium", "Medium", "Low", "Low"]


def test_brackets_are_closed_on_the_right(spark, rows):
    values = [0.0, 0.1, 0.1001, 1.0, 1.1, None, -0.1, float("nan")]
    found = column(spark, values, "double", lambda c: risk.score_bracket(numeric.finite(c)), rows)
    assert found == [0, 0, 1, 9, None, None, None, None]


def test_bracket_labels_and_bands(spark, rows):
    df = spark.range(10).select(F.col("id").cast("int").alias("b"))
    assert rows(df.select(risk.bracket_label("b")))[::9] == ["0–10%", "90–100%"]
    assert rows(df.select(risk.bracket_band("b"))) == ["low"] * 4 + ["medium"] * 3 + ["high"] * 3


def test_high_share_band(spark, rows):
    found = column(spark, [40.1, 40.0, 25.1, 25.0], "double", risk.high_share_band, rows)
    assert found == ["high", "medium", "medium", "low"]


def test_half_even(spark, rows):
    found = column(spark, [12.25, 12.35, 2.5, 3.5], "double", lambda c: numeric.half_even(c, 1), rows)
    assert found == [12.2, 12.4, 2.5, 3.5]
    assert column(spark, [2.5, 3.5], "double", lambda c: numeric.half_even(c, 0), rows) == [2.0, 4.0]


def test_money_sums_do_not_drift(spark, rows):
    df = spark.range(1000).select(F.lit(0.1).alias("x"))
    assert rows(df.agg(numeric.dollars(F.sum(numeric.cents("x"))))) == [100.0]


def test_ratio_by_zero_is_unknown(spark, rows):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert rows(df.select(numeric.ratio("a", "b"))) == [None, None, 0.25]


def test_finite(spark, rows):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, "double", numeric.finite, rows) == [1.0, None, None, None, None]


@pytest.mark.parametrize(
    "cell, number",
    [
        ("12", 12.0), (" 12.5 ", 12.5), ("-1.00", -1.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0),
        ("12d", None), ("12f", None), ("1_000", None), ("1,000", None), ("0x10", None),
        ("heavy", None), ("", None), (None, None), ("inf", float("inf")),
        ("-Infinity", float("-inf")), ("nan", None), ("+7", 7.0), ("--7", None),
    ],
)
def test_parse_number(spark, rows, cell, number):
    assert column(spark, [cell], "string", numeric.parse_number, rows) == [number]


def test_thousands(spark, rows):
    values = [-200.0, 200001.0, 2.5, 3.5, float("inf"), float("nan"), None]
    found = column(spark, values, "double", numeric.thousands, rows)
    assert found == ["-200", "200,001", "2", "4", "inf", "nan", "nan"]


def test_week_starts_on_monday(spark, rows):
    moments = [datetime(2024, 1, 7, 10), datetime(2024, 1, 8), None]
    found = column(spark, moments, "timestamp_ntz", dates.week_start, rows)
    assert found == [datetime(2024, 1, 1), datetime(2024, 1, 8), None]


def test_dates(spark, rows):
    cells = ["2024-02-29", "2024-13-01", "03/14/2026", "2024-02-29 10:30:00", "today", "", None]
    found = column(spark, cells, "string", dates.parse_date, rows)
    leap = datetime(2024, 2, 29)
    assert found == [leap, None, datetime(2026, 3, 14), leap.replace(hour=10, minute=30), None, None, None]
    assert column(spark, [leap], "timestamp_ntz", dates.us_date, rows) == ["02/29/2024"]


def test_lane(spark, rows):
    df = spark.createDataFrame([(None, "ASIA"), ("ASIA", None), ("A", "B")], "o string, d string")
    assert rows(df.select(text.lane("o", "d"))) == ["? → ASIA", "ASIA → ?", "A → B"]


def test_shorten(spark, rows):
    found = column(spark, ["x" * 28, "x" * 29, None], "string", lambda c: text.shorten(c, 28), rows)
    assert found == ["x" * 28, "x" * 25 + "…", None]
    long = column(spark, ["y" * 200], "string", lambda c: text.shorten(c, 50), rows)
    assert long == ["y" * 47 + "…"]


def test_feature_labels(spark, rows):
    names = ["carrier_Old Dominion", "facility_Yard", "weight_lbs", "miles"]
    found = column(spark, names, "string", text.feature_label, rows)
    assert found == ["Carrier: Old Dominion", "Facility: Yard", "Weight (lbs)", "Miles"]


def test_rule_score(spark, rows):
    df = spark.createDataFrame(
        [(44000.0, 5000.0), (200000.0, 5000.0), (0.0, 0.0)], "w double, m double"
    )
    assert rows(df.select(risk.rule_score("w", "m"))) == [0.7, 0.98, 0.05]


SHIPMENT = "ShipmentId string, ShipDate timestamp_ntz, CarrierId long, FacilityType string, " \
    "DistanceMiles double, weight_lbs double, LinehaulCost double, AccessorialCost double, " \
    "risk_score double, risk_tier string, OriginRegion string, DestRegion string"


def shipment(**values):
    names = [part.split()[0] for part in SHIPMENT.split(", ")]
    return tuple(values.get(n) for n in names)


def test_derived_columns(spark, rows):
    costs = [(100.0, 0.0), (100.0, None), (None, 10.0), (100.0, 50.0), (100.0, float("nan"))]
    df = spark.createDataFrame(
        [shipment(LinehaulCost=c, DistanceMiles=m, AccessorialCost=None) for c, m in costs], SHIPMENT
    )
    view = shipment_view(df)
    assert rows(view, "cost_per_mile") == [0.0, 0.0, 0.0, 2.0, 0.0]
    assert rows(view, "total_cost_usd") == [None] * 5
    total = shipment_view(
        spark.createDataFrame(
            [shipment(LinehaulCost=100.0, AccessorialCost=20.0, DistanceMiles=7.0)], SHIPMENT
        ),
        basis="total",
    )
    assert rows(total, "cost_per_mile") == [17.1429]
