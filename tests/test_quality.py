"""Upload checks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from haulscope.operators import quality, scoring
from haulscope.schemas import UPLOAD_COLUMNS

GOOD = ("S1", "2024-01-01", "Acme", "Yard", "1000", "500", "900.00", "50")
SCHEMA = "row_num int, " + ", ".join(f"{c} string" for c in UPLOAD_COLUMNS)


def upload(spark, *changes):
    """One row per change set, numbered from 2."""
    data = []
    for number, change in enumerate(changes, 2):
        row = dict(zip(UPLOAD_COLUMNS, GOOD)) | change
        data.append((number, *row.values()))
    return spark.createDataFrame(data, SCHEMA)


def rules(spark, rows, change, checks=None):
    checked = quality.check(upload(spark, change), checks)
    return rows(quality.messages(checked).orderBy("position"), "rule")


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"shipment_id": None}, ["shipment_id_missing"]),
        ({"carrier": "  \t "}, ["carrier_missing"]),
        ({"facility": ""}, ["facility_missing"]),
        ({"ship_date": "2024-13-01"}, ["ship_date_invalid"]),
        ({"ship_date": None}, []),
        ({"weight_lbs": "200000"}, []),
        ({"weight_lbs": "200000.5"}, ["weight_lbs_range"]),
        ({"weight_lbs": "heavy"}, ["weight_lbs_not_number"]),
        ({"weight_lbs": None}, ["weight_lbs_range"]),
        ({"weight_lbs": "inf"}, ["weight_lbs_range"]),
        ({"miles": "0"}, []),
        ({"miles": "-450.00"}, ["miles_range"]),
        ({"miles": "about 500"}, ["miles_not_number"]),
        ({"base_freight_usd": None}, []),
        ({"base_freight_usd": "-0.01"}, ["base_freight_usd_negative"]),
        ({"base_freight_usd": "1_000"}, ["base_freight_usd_not_number"]),
        ({"accessorial_charge_usd": None}, ["accessorial_charge_usd_blank"]),
        ({"accessorial_charge_usd": "-5"}, ["accessorial_charge_usd_negative"]),
        ({"accessorial_charge_usd": "n/a"}, ["accessorial_charge_usd_not_number"]),
        (
            {"shipment_id": "", "miles": "x", "accessorial_charge_usd": ""},
            ["shipment_id_missing", "miles_not_number", "accessorial_charge_usd_blank"],
        ),
    ],
)
def test_standard_rules(spark, rows, change, expected):
    assert rules(spark, rows, change) == expected


@pytest.mark.parametrize(
    "change, message",
    [
        ({"carrier": ""}, "Row 2: 'carrier' is empty or missing."),
        ({"ship_date": "soon"}, "Row 2: 'ship_date' value 'soon' is not a valid date."),
        ({"weight_lbs": "-200"}, "Row 2: 'weight_lbs' value -200 is out of range (0–200,000)."),
        ({"miles": "6500"}, "Row 2: 'miles' value 6,500 is out of range (0–5,000)."),
        ({"miles": None}, "Row 2: 'miles' value nan is out of range (0–5,000)."),
        ({"miles": "far"}, "Row 2: 'miles' is not a number."),
        ({"base_freight_usd": "-1"}, "Row 2: 'base_freight_usd' cannot be negative."),
        (
            {"accessorial_charge_usd": ""},
            "Row 2: 'accessorial_charge_usd' is blank — defaulted to 0.",
        ),
    ],
)
def test_messages(spark, rows, change, message):
    checked = quality.check(upload(spark, change))
    assert rows(quality.messages(checked), "message") == [message]


def test_rows_passed_both_ways(spark, rows):
    broken = {"shipment_id": "", "carrier": "", "facility": "", "miles": "x", "weight_lbs": "x"}
    checked = quality.check(upload(spark, {}, broken, {}))
    assert rows(quality.summary(checked)) == [(3, 5, 0, -2, 2, False)]
    assert rows(quality.clean_rows(checked), "row_num") == [2, 4]
    assert rows(quality.quarantined_rows(checked), "row_num") == [3]
    assert not quality.may_score(checked)


def test_warnings_do_not_block(spark, rows):
    checked = quality.check(upload(spark, {"accessorial_charge_usd": ""}))
    assert quality.may_score(checked)
    assert rows(quality.summary(checked)) == [(1, 0, 1, 1, 1, True)]


def test_first_messages(spark, rows):
    df = upload(spark, *[{"carrier": "", "miles": "x"}] * 40)
    first = rows(quality.first_messages(df))
    assert len(first) == 50 and {row[3] for row in first} == {30}
    assert [row[0] for row in first] == [2 + i // 2 for i in range(50)]
    few = rows(quality.first_messages(upload(spark, {"carrier": ""})))
    assert few == [(2, "carrier_missing", "Row 2: 'carrier' is empty or missing.", 0)]


def test_frame(spark):
    df = upload(spark, {})
    assert quality.frame_issues(df) == []
    found = quality.frame_issues(df.drop("carrier", "miles").withColumn("notes", F.lit("x")))
    assert [f["rule"] for f in found] == ["missing_columns", "extra_columns"]
    assert found[0]["message"] == "Missing required column(s): carrier, miles"


def test_size(spark):
    assert quality.size_issue(upload(spark, {}).limit(0))["rule"] == "empty_file"
    assert quality.size_issue(upload(spark, {}))["rule"] == "small_file"
    assert quality.size_issue(upload(spark, *[{}] * 10)) is None


@pytest.mark.parametrize(
    "check, change, hits",
    [
        (quality.date_required, {"ship_date": ""}, True),
        (quality.positive_miles, {"miles": "0"}, True),
        (quality.positive_miles, {"miles": "1"}, False),
        (quality.long_distance, {"miles": "6000"}, True),
        (lambda: quality.future_date("2024-01-01"), {"ship_date": "2024-01-02"}, True),
        (lambda: quality.future_date("2024-01-01"), {"ship_date": "2024-01-01"}, False),
        (lambda: quality.in_domain("facility", ["Yard"]), {"facility": "Customer Warehouse"}, True),
        (lambda: quality.in_domain("facility", ["Yard"]), {}, False),
        (lambda: quality.state_code("carrier"), {"carrier": "Texas"}, True),
        (lambda: quality.state_code("carrier"), {"carrier": "TX"}, False),
        (lambda: quality.encoding_damage("facility"), {"facility": "Fr�ight"}, True),
        (lambda: quality.encoding_damage("facility"), {"facility": "Frëïght™"}, False),
    ],
)
def test_further_rules(spark, rows, check, change, hits):
    assert bool(rules(spark, rows, change, [check()])) is hits


def test_missing_tier(spark, rows):
    df = upload(spark, {}, {}).withColumn("risk_tier", F.when(F.col("row_num") == 2, "High"))
    checked = quality.check(df, [quality.missing_tier()])
    assert rows(quality.messages(checked), "row_num", "severity") == [(3, "warning")]
    assert rows(quality.default_tier(df), "risk_tier") == ["High", "Low"]


def test_flag_correction(spark, rows):
    data = [(1, 150.0, 0), (2, 0.0, 0), (3, None, 0), (4, 10.0, 1), (5, 10.0, None)]
    df = spark.createDataFrame(data, "row_num int, cost double, flag int")
    fixed = quality.correct_flag(df, "cost", "flag").orderBy("row_num")
    assert rows(fixed, "flag") == [1, 0, 0, 1, None]
    assert rows(fixed, "flag_was_corrected") == [True, False, False, False, False]


def test_spelling(spark, rows):
    names = ["XPO Logistics", "XPO Logistics", "xpo logistics", " XPO LOGISTICS ", "ABF", "", None]
    df = spark.createDataFrame([(n,) for n in names], "carrier string")
    found = rows(quality.near_duplicates(df), "spelling", "variants", "canonical")
    assert {f[0] for f in found} == {"XPO Logistics", "xpo logistics", " XPO LOGISTICS "}
    assert {f[1:] for f in found} == {(3, "XPO Logistics")}
    unified = rows(quality.unify_spelling(df), "carrier")
    assert sorted(map(str, unified)) == ["", "ABF", *["None"], *["XPO Logistics"] * 4]


def test_duplicates(spark, rows):
    ids = ["A", "B", "A", None, None, "A", ""]
    df = spark.createDataFrame(list(enumerate(ids, 2)), "row_num int, shipment_id string")
    assert rows(quality.duplicate_ids(df)) == [("A", 3, 2, 7)]
    assert sorted(rows(quality.duplicate_rows(df), "row_num")) == [2, 4, 7]
    assert sorted(rows(quality.keep_one(df), "row_num")) == [2, 3, 5, 6, 8]
    assert sorted(rows(quality.keep_one(df, "last"), "row_num")) == [3, 5, 6, 7, 8]


def test_one_id_on_a_third_of_all_rows(spark, rows):
    df = spark.range(3000).select(
        F.col("id").alias("row_num"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("shipment_id"),
    )
    assert rows(quality.duplicate_ids(df)) == [("hot", 1000, 0, 2997)]
    assert quality.keep_one(df).count() == 2001


def test_duplicate_policies(spark, rows):
    existing = spark.createDataFrame([("A", 1), ("B", 1)], "shipment_id string, v int")
    incoming = spark.createDataFrame(
        [(2, "B", 2), (3, "C", 2), (4, "C", 3)], "row_num int, shipment_id string, v int"
    )
    skipped = quality.resolve_duplicates(existing, incoming, "skip")
    assert sorted(rows(skipped)) == [("A", 1), ("B", 1), ("C", 2)]
    updated = quality.resolve_duplicates(existing, incoming, "update")
    assert sorted(rows(updated)) == [("A", 1), ("B", 2), ("C", 3)]
    with pytest.raises(ValueError, match="cancelled"):
        quality.resolve_duplicates(existing, incoming, "cancel")
    fresh = spark.createDataFrame([(2, "D", 2)], "row_num int, shipment_id string, v int")
    assert quality.resolve_duplicates(existing, fresh, "cancel").count() == 3
    with pytest.raises(ValueError, match="unknown policy"):
        quality.resolve_duplicates(existing, fresh, "merge")


def test_score(spark, rows):
    df = upload(
        spark,
        {"weight_lbs": "44000", "miles": "5000"},
        {"weight_lbs": "200000", "miles": "5000"},
        {"weight_lbs": None, "miles": "x"},
    )
    found = rows(scoring.score(df).orderBy("row_num"), "risk_score", "risk_tier")
    assert found == [(0.7, "High"), (0.98, "High"), (0.05, "Low")]


def test_hashed_noise_does_not_depend_on_partitions(spark, rows):
    df = upload(spark, *[{"shipment_id": f"S{i}"} for i in range(50)])
    one = rows(scoring.score(df.coalesce(1), "hash").orderBy("row_num"), "risk_score")
    seven = rows(scoring.score(df.repartition(7), "hash").orderBy("row_num"), "risk_score")
    assert one == seven and len(set(one)) > 30
    plain = rows(scoring.score(df), "risk_score")[0]
    assert all(plain <= value <= plain + 0.2 + 1e-9 for value in one)
    with pytest.raises(ValueError):
        scoring.score(df, "dice")


def test_amounts_with_more_than_two_digits_are_reported(spark, rows):
    cells = ["0.29", "1234567.89", "0.295", "-3.001", "7", None, "x"]
    df = spark.createDataFrame(
        [(i, f"S{i}", c) for i, c in enumerate(cells)], "row_num int, shipment_id string, base_freight_usd string"
    )
    checked = quality.check(df, [quality.whole_cents("base_freight_usd")])
    assert sorted(rows(quality.messages(checked), "row_num")) == [2, 3]


@pytest.mark.parametrize(
    "column, cell, rules",
    [
        ("weight_lbs", "  ", ["weight_lbs_not_number"]),
        ("miles", " ", ["miles_not_number"]),
        ("base_freight_usd", "   ", ["base_freight_usd_not_number"]),
        ("accessorial_charge_usd", "  ", ["accessorial_charge_usd_blank", "accessorial_charge_usd_not_number"]),
        ("ship_date", "  ", ["ship_date_invalid"]),
        ("ship_date", "2024-01-05T10:00:00", []),
        ("ship_date", "2024/01/05", []),
        ("ship_date", "1/5/2024", []),
        ("ship_date", "13/5/2024", ["ship_date_invalid"]),
    ],
)
def test_white_space_is_no_value_and_more_date_texts_are_read(spark, rows, column, cell, rules):
    good = {
        "shipment_id": "S1", "ship_date": "2024-01-05", "carrier": "Acme", "facility": "Yard",
        "weight_lbs": "1000", "miles": "10", "base_freight_usd": "5", "accessorial_charge_usd": "0",
    }
    cells = good | {column: cell}
    df = spark.createDataFrame([(2, *cells.values())], ["row_num", *cells])
    assert sorted(rows(quality.messages(quality.check(df)), "rule")) == rules


def test_skip_and_update_do_not_shuffle_the_stored_table(spark):
    stored = spark.range(5_000).selectExpr("concat('S', id) shipment_id", "id * 2 AS miles")
    incoming = spark.createDataFrame([("S7", 1, 2), ("N1", 2, 3), ("N1", 3, 4), (None, 4, 5)], "shipment_id string, miles bigint, row_num int")
    skipped = quality.resolve_duplicates(stored, incoming, "skip")
    assert skipped.count() == 5_002 and skipped.where("shipment_id = 'N1'").first().miles == 2
    updated = quality.resolve_duplicates(stored, incoming, "update")
    assert updated.count() == 5_002 and updated.where("shipment_id = 'S7'").first().miles == 1
    plan = updated._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError):
        quality.resolve_duplicates(stored, incoming, "cancel")
    assert quality.resolve_duplicates(stored, incoming.where("row_num = 3"), "cancel").count() == 5_001


def test_values_outside_a_reference_table_are_errors(spark):
    rows = spark.createDataFrame(
        [(i, f"S{i}", c) for i, c in enumerate(["Acme", "acme", None, " ", "Bolt", "acme"], 2)],
        "row_num int, shipment_id string, carrier string",
    )
    table = spark.createDataFrame([("Acme",), ("Bolt",), (None,), ("Acme",)], "carrier_name string")
    marked = quality.with_reference(rows, "carrier", table, "carrier_name")
    checked = quality.check(marked, [quality.in_reference("carrier", "the carriers table")])
    found = {r.row_num: r.message for r in quality.messages(checked).collect()}
    text = "'carrier' value 'acme' is not in the carriers table."
    assert found == {3: f"Row 3: {text}", 7: f"Row 7: {text}"}
    assert quality.clean_rows(checked).count() == 4
