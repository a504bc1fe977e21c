"""Filters, joins, rollups, rankings and metrics on hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from haulscope import FreightTables, Selection, schemas
from haulscope.operators import enrich, filters, joins, ranking
from haulscope.operators.rollups import regroup, shipment_rollup
from haulscope.plans import accessorials, carriers, overview, routes, shipments

DAY = datetime(2024, 1, 8)


def shipment(number, **values):
    row = {
        "ShipmentId": f"S{number}", "ShipDate": DAY, "CarrierId": 1, "FacilityType": "Yard",
        "DistanceMiles": 100.0, "weight_lbs": 1000.0, "LinehaulCost": 200.0, "AccessorialCost": 0.0,
        "risk_score": 0.5, "risk_tier": "Medium", "OriginRegion": "A", "DestRegion": "B",
    } | values
    return tuple(row.get(name) for name in schemas.SHIPMENTS.names)


def charge(number, shipment_id, amount, **values):
    row = {
        "charge_id": f"C{number}", "shipment_id": shipment_id, "amount": amount,
        "charge_type": "Detention", "invoice_date": DAY,
    } | values
    return tuple(row.get(name) for name in schemas.CHARGES.names)


def bundle(spark, shipped, charged=(), names=((1, "Acme"), (2, "Bolt"))):
    return FreightTables(
        shipments=spark.createDataFrame(list(shipped), schemas.SHIPMENTS),
        charges=spark.createDataFrame(list(charged), schemas.CHARGES),
        carriers=spark.createDataFrame(
            [(i, n, None, None, None, None, None) for i, n in names], schemas.CARRIERS
        ),
        facilities=spark.createDataFrame([], schemas.FACILITIES),
    )


# --- filters --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def few(spark):
    return bundle(
        spark,
        [
            shipment(1, ShipDate=datetime(2024, 1, 1), CarrierId=1, risk_tier="High"),
            shipment(2, ShipDate=datetime(2024, 1, 2), CarrierId=2, FacilityType="Dock"),
            shipment(3, ShipDate=datetime(2024, 1, 3, 9), CarrierId=None, risk_tier="Low"),
            shipment(4, ShipDate=None, CarrierId=9),
        ],
    )


def ids(rows, df):
    return sorted(rows(df, "shipment_id"))


def test_orphans_keep_no_name(few, rows):
    found = dict(rows(shipments.named_shipments(few), "shipment_id", "carrier"))
    assert found == {"S1": "Acme", "S2": "Bolt", "S3": None, "S4": None}


def test_empty_lists_do_not_filter(few, rows):
    assert ids(rows, shipments.named_shipments(few, Selection())) == ["S1", "S2", "S3", "S4"]


def test_dates_include_both_midnights(few, rows):
    chosen = Selection(date(2024, 1, 1), "2024-01-03")
    assert ids(rows, shipments.named_shipments(few, chosen)) == ["S1", "S2"]
    assert len(ids(rows, shipments.named_shipments(few, Selection(start="2024-01-02")))) == 4


def test_lists(few, rows):
    for chosen, expected in [
        (Selection(carriers=["Acme", "Bolt"]), ["S1", "S2"]),
        (Selection(facilities=["Dock"]), ["S2"]),
        (Selection(tiers=["High", "Low"]), ["S1", "S3"]),
        (Selection(carriers=["Acme"], facilities=["Dock"]), []),
    ]:
        assert ids(rows, shipments.named_shipments(few, chosen)) == expected


def test_comparison_of_no_carriers_is_empty(few):
    assert carriers.carrier_metrics(few, []).count() == 0
    assert carriers.carrier_metrics(few).count() == 2


def test_search(spark, rows):
    df = spark.createDataFrame([("SHP-1",), ("shp-2",), (None,), ("X.1",)], "shipment_id string")
    assert rows(filters.search_id(df, "shp")) == ["SHP-1"]
    assert rows(filters.search_id(df, "x.1")) == ["X.1"]
    assert rows(filters.search_id(df, "p.1")) == ["SHP-1"]
    assert rows(filters.search_id(df, "p.1", mode="literal")) == []


def test_lookup(few):
    assert shipments.lookup(few, "S2").count() == 1
    assert shipments.lookup(few, "S9").count() == 0


def test_unknown_type_is_added_only_if_absent(spark, rows):
    df = spark.createDataFrame([(1, "Layover")], "k int, accessorial_type string")
    assert rows(enrich.with_default_type(df), "accessorial_type") == ["Layover"]
    assert rows(enrich.with_default_type(df.drop("accessorial_type")), "accessorial_type") == ["Unknown"]


# --- metrics --------------------------------------------------------------------------------


def test_sums_of_nothing_are_zero(spark, rows):
    empty = bundle(spark, [])
    assert rows(overview.operations_kpis(empty)) == [(0, 0.0, 0.0, 0.0, None, 0.0)]
    assert rows(overview.risk_kpis(empty)) == [(0, 0.0, 0, 0.0)]
    assert rows(accessorials.accessorial_kpis(empty)) == [(0.0, 0, 0, 0.0, 0.0, 0.0, 0.0)]
    assert rows(overview.risk_histogram(empty), "count") == [0] * 10
    assert rows(routes.route_extremes(empty), "groups", "busiest") == [(0, "—")]
    assert overview.weekly_operations(empty).count() == 0


def test_unknown_amounts(spark, rows):
    t = bundle(
        spark,
        [shipment(1, AccessorialCost=None), shipment(2, AccessorialCost=50.0, LinehaulCost=100.0)],
    )
    (found,) = carriers.carrier_metrics(t).collect()
    assert (found.shipments, found.avg_cost, found.total_spend) == (2, 150.0, 150.0)
    assert (found.total_accessorial, found.avg_accessorial) == (50.0, 50.0)


def test_extremes_break_ties_by_key(spark, rows):
    t = bundle(
        spark,
        [shipment(i, OriginRegion=o) for i, o in enumerate("ZZAABB")]
        + [shipment(9, OriginRegion="C", LinehaulCost=900.0)],
    )
    found = routes.route_extremes(t, "origin_city", min_shipments=1).first()
    assert (found.groups, found.busiest, found.cheapest, found.dearest) == (4, "A", "A", "C")
    assert routes.route_metrics(t, "origin_city").count() == 3


def test_radar(spark, rows):
    names = ((1, "Acme"), (2, "Bolt"), (3, "Core"))
    shipped = [
        shipment(i, CarrierId=i, LinehaulCost=cost, DistanceMiles=100.0)
        for i, cost in ((1, 200.0), (2, 400.0), (3, 300.0))
    ]
    found = {r.carrier: r for r in carriers.carrier_radar(bundle(spark, shipped, names=names)).collect()}
    assert [found[n].cost_score for n in ("Acme", "Bolt", "Core")] == [1.0, 0.0, 0.5]
    assert {r.low_risk_score for r in found.values()} == {0.5}


def test_charges_repeat_the_base(spark, rows):
    t = bundle(
        spark,
        [shipment(1, LinehaulCost=100.0)],
        [charge(1, "S1", 30.0), charge(2, "S1", 20.0), charge(3, "S?", 50.0), charge(4, None, None)],
    )
    per_charge = accessorials.accessorial_kpis(t).first()
    assert (per_charge.total_accessorial, per_charge.charged_rows, per_charge.total_rows) == (100.0, 3, 4)
    assert (per_charge.max_charge, per_charge.pct_of_spend) == (50.0, 33.3)
    once = accessorials.accessorial_kpis(t, grain="shipment").first()
    assert once.pct_of_spend == 50.0
    lines = enrich.charge_lines(t.charges, t.shipments, t.carriers)
    assert dict(rows(lines, "charge_id", "total_cost_usd")) == {"C1": 130.0, "C2": 120.0, "C3": 50.0, "C4": 0.0}


def test_unknown_amount_counts_as_not_charged(spark, rows):
    t = bundle(spark, [shipment(1)], [charge(1, "S1", 10.0), charge(2, "S1", None)])
    (found,) = accessorials.tier_outcomes(t).collect()
    assert (found.risk_tier, found["count"], found.avg_acc, found.pct_with_acc) == ("Medium", 2, 10.0, 50.0)


def test_tiers_are_listed_low_to_high(spark, rows):
    t = bundle(
        spark,
        [shipment(i, risk_tier=tier) for i, tier in enumerate(("High", "Low", "Medium"))],
        [charge(i, f"S{i}", 1.0) for i in range(3)],
    )
    assert rows(accessorials.tier_outcomes(t), "risk_tier") == ["Low", "Medium", "High"]


def test_rollups_can_be_grouped_again(spark, tables):
    view = enrich.shipment_view(tables.shipments)
    direct = shipment_rollup(view, "risk_tier")
    again = regroup(shipment_rollup(view, "risk_tier", "facility", "carrier_id"), "risk_tier")
    exact = [c for c in direct.columns if not c.endswith("_sum")]
    assert sorted(map(tuple, direct.select(exact).collect())) == sorted(
        map(tuple, again.select(exact).collect())
    )


# --- rankings -------------------------------------------------------------------------------


def test_similar_shipments_of_a_dominant_carrier(spark, rows):
    shipped = [shipment(f"{i:03}", ShipDate=datetime(2024, 1, 1 + i % 28)) for i in range(200)]
    shipped += [shipment(900 + i, CarrierId=2) for i in range(3)]
    shipped += [shipment(999, CarrierId=None)]
    found = shipments.similar(bundle(spark, shipped))
    counts = dict(rows(found.groupBy("carrier").count()))
    assert counts == {"Acme": 10, "Bolt": 3}
    first = found.where("carrier = 'Acme' AND place = 1").first()
    assert (first.shipment_id, first.ship_date) == ("S027", datetime(2024, 1, 28))


def test_ids_that_share_a_name_are_ranked_together(spark, rows):
    shipped = [shipment(i, CarrierId=1 + i % 2, ShipDate=datetime(2024, 1, 1 + i)) for i in range(24)]
    found = shipments.similar(bundle(spark, shipped, names=((1, "Acme"), (2, "Acme"))))
    assert sorted(rows(found, "shipment_id")) == sorted(f"S{i}" for i in range(14, 24))


def test_factor_breakdown(spark, rows):
    df = spark.createDataFrame(
        [("S1", "Acme", "Yard", 2500.0, 22000.0, 2500.0), ("S2", None, None, None, 1.0, 1.0)],
        "shipment_id string, carrier string, facility string, miles double, weight_lbs double, "
        "base_freight_usd double",
    )
    found = ranking.risk_factors(df).where("shipment_id = 'S1'").orderBy("factor_rank")
    assert rows(found, "factor", "weight") == [
        ("Carrier History", 0.25), ("Facility Profile", 0.2), ("Miles / Distance", 0.1),
        ("Shipment Weight", 0.08), ("Base Freight Rate", 0.05),
    ]
    assert sum(rows(found, "share_pct")) == pytest.approx(100, abs=0.01)
    unknown = ranking.risk_factors(df).where("shipment_id = 'S2'").orderBy("factor_rank")
    assert rows(unknown, "factor")[-1] == "Miles / Distance"
    assert set(rows(unknown, "share_pct")) == {None}


def test_watched_names_weigh_more(spark, rows):
    df = spark.createDataFrame(
        [("S1", "XPO Logistics", "Warehouse B - Memphis", 0.0, 0.0, 9000.0)],
        "shipment_id string, carrier string, facility string, miles double, weight_lbs double, "
        "base_freight_usd double",
    )
    found = dict(rows(ranking.risk_factors(df), "factor", "weight"))
    assert (found["Carrier History"], found["Facility Profile"]) == (0.4, 0.35)
    assert found["Base Freight Rate"] == 0.1


def test_recommended_actions(spark, rows):
    df = spark.createDataFrame(
        [("A", "High", 1000.0), ("B", "Medium", 1001.0), ("C", None, None), ("D", "High", None)],
        "shipment_id string, risk_tier string, accessorial_charge_usd double",
    )
    found = ranking.recommended_actions(df)
    assert dict(rows(found.groupBy("shipment_id").count())) == {"A": 4, "B": 3, "C": 2, "D": 4}
    texts = dict(rows(found.where("action LIKE '%buffer%'"), "shipment_id", "action"))
    assert texts["A"] == "Add an accessorial buffer of $800 – $1,200 to your quote."
    assert texts["B"] == "Consider a $500 – $1,001 contingency buffer in your pricing."
    assert texts["D"] == "Add an accessorial buffer of $nan – $nan to your quote."


def test_pages_meet(spark, rows):
    df = spark.range(1, 101).select(F.format_string("S%03d", "id").alias("shipment_id"))
    second = rows(ranking.page(df, 2))
    assert second == [f"S{i:03}" for i in range(26, 51)]
    assert rows(ranking.page_after(df, "S025")) == second
    assert rows(ranking.page(df, 5)) == []


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_context_of_few_rows(spark, rows, monkeypatch, limit):
    few = spark.createDataFrame([("A", 1), ("Z", 2), (None, 3)], "k string, n int")
    many = spark.createDataFrame([("A", 10), ("B", 20)], "k string, v int")
    monkeypatch.setattr(joins.join_measured, "__defaults__", (limit,))
    found = ranking.context_of(few, many, "k")
    assert sorted(rows(found, "n", "v")) == [(1, 10), (2, None), (3, None)]


def test_a_side_is_broadcast_only_below_the_limit(spark):
    large, side = spark.range(1000), spark.range(100).withColumn("t", F.lit("x" * 36))
    assert joins.size_of(side) == 100 * 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        small = plan_of(joins.join_measured(large, side, "id", "left", limit=10_000))
        beyond = plan_of(joins.join_measured(large, side, "id", "left", limit=9_999))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "SortMergeJoin" in beyond


def test_latest(spark, rows):
    df = spark.createDataFrame(
        [("b", DAY), ("a", DAY), ("c", None), ("d", datetime(2024, 2, 1))], "k string, ship_date timestamp_ntz"
    )
    assert rows(ranking.latest(df, 3, "k"), "k") == ["d", "a", "b"]


# --- plans ----------------------------------------------------------------------------------

INVARIANT = (
    "carrier_metrics", "lane_metrics", "tier_outcomes", "similar_shipments", "risk_kpis_delta",
    "charges_by_carrier", "week_over_week",
)


@pytest.mark.parametrize("name", INVARIANT)
def test_partitions_do_not_matter(name, spark, folder, monkeypatch):
    from haulscope.sources import star_schema

    def answer(partitions):
        original = star_schema._run
        with monkeypatch.context() as patch:
            patch.setattr(
                star_schema, "_run", lambda *args: original(*args).repartition(partitions)
            )
            entry._tables.cache_clear()
            df = entry.queries()[name](spark, folder)
            assert "REPARTITION_BY_NUM" in plan_of(df)
            found = sorted(map(str, df.collect()))
        entry._tables.cache_clear()
        return found

    assert answer(1) == answer(7)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - {"cost_predictions", "feature_importance"}))
def test_no_plan_multiplies_tables(name, spark, folder):
    plan = plan_of(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_charge_types_do_not_read_shipments(spark, folder):
    plan = plan_of(entry.queries()["charges_by_type"](spark, folder))
    assert "lineitem.parquet" in plan and "orders.parquet" not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(entry.queries()["ops_weekly_filtered"](spark, folder))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan


def test_group_limit_before_the_shuffle(spark, folder):
    plan = plan_of(entry.queries()["similar_shipments"](spark, folder))
    assert "WindowGroupLimit" in plan and "Partial" in plan


# Facts that meet carriers: none of them may be shuffled by carrier for it.
CARRIER_JOINS = (
    "enriched_shipments charge_lines shipments_by_weight fallback_source search_shipments "
    "filtered_shipments similar_to_one risk_factors ops_weekly_filtered accessorial_kpis_filtered "
    "charges_by_type_filtered charges_by_carrier_filtered charges_weekly_filtered"
).split()


@pytest.mark.parametrize("name", CARRIER_JOINS)
def test_facts_are_not_shuffled_by_carrier(name, spark, folder):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(carrier_id" in line]
    # Sums per carrier are shuffled, a row for each carrier and task; facts are not.
    assert name.startswith("charges_by_carrier") or not shuffles
    assert "BroadcastHashJoin" in plan


def test_lookup_takes_the_newest_of_repeated_ids(spark):
    rows = [("S1", day, cost) for day, cost in (("2024-01-01", 1.0), ("2024-03-01", 3.0), (None, 9.0), ("2024-02-01", 2.0))]
    df = spark.createDataFrame(rows, "shipment_id string, ship_date string, cost double")
    assert [r.cost for r in filters.lookup(df, "S1").collect()] == [3.0]


def test_a_week_without_rows_leaves_no_change_to_compare(spark, monkeypatch):
    days = ["2024-01-02", "2024-01-09", "2024-01-30"]
    few = bundle(spark, [shipment(i, ShipDate=datetime.fromisoformat(d)) for i, d in enumerate(days)])
    found = overview.week_over_week(few).collect()
    assert [r.shipments_change for r in found] == [None, 0.0, None]
