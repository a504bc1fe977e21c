"""Cost estimate: model, comparison, guards and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.functions.numeric import percent
from haulscope.operators import cost_model, guards, metrics, ranges
from haulscope.operators.enrich import shipment_view
from haulscope.operators.rollups import shipment_rollup
from haulscope.plans.scope import shipments_in
from haulscope.plans.shipments import named_shipments
from haulscope.sources.tables import FreightTables


def fleet_baselines(tables: FreightTables) -> DataFrame:
    return metrics.fleet_baselines(shipment_rollup(shipments_in(tables)))


def cost_histogram(tables: FreightTables, bins: int = 30) -> DataFrame:
    return metrics.cost_histogram(shipment_view(tables.shipments), bins)


def estimate_position(tables: FreightTables, estimates: list[float]) -> DataFrame:
    return metrics.estimate_position(shipment_view(tables.shipments), estimates)


def estimate_positions(tables: FreightTables, estimates: DataFrame, column: str = "estimate") -> DataFrame:
    """Any table of estimates with ``below``, ``history`` and ``percentile``: the share of past shipments
    that cost no more than each estimate."""
    past = shipment_view(tables.shipments).select("total_cost_usd")
    placed = ranges.positions(past, "total_cost_usd", estimates, column)
    return placed.withColumn("percentile", percent("below", "history", 4))


def freight_positions(tables: FreightTables) -> DataFrame:
    """Every shipment's base freight among the total costs of all shipments."""
    freight = shipment_view(tables.shipments).select("shipment_id", F.col("base_freight_usd").alias("estimate"))
    return estimate_positions(tables, freight)


def fit(tables: FreightTables, **settings) -> cost_model.CostModel:
    return cost_model.fit(named_shipments(tables), **settings)


def estimates(tables: FreightTables, model: cost_model.CostModel, *, each_tree: bool = True) -> DataFrame:
    """Estimate, interval and comparison for every shipment; missing features are filled. ``each_tree`` adds
    what every single tree says."""
    rows = named_shipments(tables).select("shipment_id", "carrier", "facility", "weight_lbs", "miles")
    return cost_model.compare(cost_model.predict(model, rows, each_tree=each_tree), fleet_baselines(tables))


def model_guards(tables: FreightTables) -> DataFrame:
    """Guards over the shipments, the accessorial flag being the outcome."""
    return guards.training_guards(guards.training_facts(tables.shipments, "AccessorialFlag", "CarrierId"))


def class_weights(tables: FreightTables) -> DataFrame:
    return guards.class_weights(tables.shipments, "AccessorialFlag")


def range_warnings(tables: FreightTables, new: DataFrame) -> DataFrame:
    features = ("weight_lbs", "miles")
    ranges = guards.feature_ranges(shipment_view(tables.shipments), *features)
    return guards.range_warnings(new, ranges, *features)
