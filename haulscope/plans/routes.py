"""Route analysis by lane, origin or destination."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.functions.text import lane
from haulscope.operators import metrics
from haulscope.operators.filters import Selection
from haulscope.operators.rollups import regroup, shipment_rollup
from haulscope.plans.scope import EVERYTHING, shipments_in
from haulscope.sources.tables import FreightTables

# Fixed value: least shipments of a group worth showing.
MIN_SHIPMENTS = 2


def route_metrics(
    tables: FreightTables,
    key: str = "lane",
    min_shipments: int = MIN_SHIPMENTS,
    chosen: Selection = EVERYTHING,
) -> DataFrame:
    """``key`` is ``lane``, ``origin_city`` or ``destination_city``.

    Lanes are summed by their two ends; the label is built once per lane, not once per row.
    """
    view = shipments_in(tables, chosen)
    if key == "lane":
        ends = shipment_rollup(view, "origin_city", "destination_city")
        rollup = regroup(ends.withColumn("lane", lane("origin_city", "destination_city")), "lane")
    else:
        rollup = shipment_rollup(view.where(F.col(key).isNotNull()), key)
    return metrics.lane_metrics(rollup, key, min_shipments)


def route_extremes(tables: FreightTables, key: str = "lane", **scope) -> DataFrame:
    return metrics.lane_extremes(route_metrics(tables, key, **scope), key)


def route_points(tables: FreightTables, key: str = "lane", **scope) -> DataFrame:
    return metrics.lane_points(route_metrics(tables, key, **scope), key)


def dearest(tables: FreightTables, key: str = "lane", rows: int = 8, **scope) -> DataFrame:
    return metrics.lane_top(route_metrics(tables, key, **scope), key, rows)


def cheapest(tables: FreightTables, key: str = "lane", rows: int = 8, **scope) -> DataFrame:
    return metrics.lane_top(route_metrics(tables, key, **scope), key, rows, dearest=False)


def breakdown(tables: FreightTables, key: str = "lane", **scope) -> DataFrame:
    return metrics.lane_breakdown(route_metrics(tables, key, **scope), key)
