"""Logical views of shipments and charges, and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.functions.numeric import finite, ratio, zero_if_null
from haulscope.functions.text import lane
from haulscope.operators.joins import ids_in_use, join_measured

# Stored name -> logical name.
SHIPMENT_NAMES = {
    "ShipmentId": "shipment_id",
    "ShipDate": "ship_date",
    "FacilityType": "facility",
    "DistanceMiles": "miles",
    "LinehaulCost": "base_freight_usd",
    "AccessorialCost": "accessorial_charge_usd",
    "CarrierId": "carrier_id",
}
CHARGE_NAMES = {
    "charge_type": "accessorial_type",
    "amount": "accessorial_charge_usd",
    "invoice_date": "ship_date",
}
MEASURED = ("miles", "weight_lbs", "base_freight_usd", "accessorial_charge_usd", "risk_score")


def shipment_view(shipments: DataFrame, basis: str = "base") -> DataFrame:
    """Logical names and derived columns; the carrier is still an id.

    ``cost_per_mile`` is 0 where it is unknown. ``basis='total'`` divides the total cost,
    rounded to 4 digits, instead of the base freight.
    """
    view = shipments.withColumnsRenamed(SHIPMENT_NAMES)
    view = view.withColumns({name: finite(name) for name in MEASURED})
    total = F.col("base_freight_usd") + F.col("accessorial_charge_usd")
    per_mile = {
        "base": ratio("base_freight_usd", F.nullif("miles", F.lit(0.0))),
        "total": F.when(F.col("miles") > 0, F.rint(total / F.col("miles") * 10000) / 10000),
    }[basis]
    return view.withColumns(
        {
            "total_cost_usd": total,
            "cost_per_mile": F.coalesce(per_mile, F.lit(0.0)),
            "lane": lane("OriginRegion", "DestRegion"),
            "origin_city": F.col("OriginRegion"),
            "destination_city": F.col("DestRegion"),
        }
    )


def charge_view(charges: DataFrame) -> DataFrame:
    view = with_default_type(charges.withColumnsRenamed(CHARGE_NAMES))
    return view.withColumn("accessorial_charge_usd", finite("accessorial_charge_usd"))


def carrier_names(carriers: DataFrame) -> DataFrame:
    return carriers.select("carrier_id", F.col("carrier_name").alias("carrier"))


def with_carrier(view: DataFrame, carriers: DataFrame) -> DataFrame:
    """LEFT join on the carrier id; an unknown carrier keeps a NULL name.

    For results of a few rows. Facts of any size use ``with_used_carrier``.
    """
    return view.join(carrier_names(carriers), "carrier_id", "left")


def with_used_carrier(view: DataFrame, carriers: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``with_carrier`` for a fact table: it meets only the carriers that it uses, and in place.

    ``keys`` is a frame with all carrier ids of ``view`` that is cheaper to read, if there is one.
    Runs small jobs: see ``join_measured``.
    """
    used = ids_in_use(carrier_names(carriers), view if keys is None else keys, "carrier_id")
    return join_measured(view, used, "carrier_id", "left")


def charge_lines(charges: DataFrame, shipments: DataFrame, carriers: DataFrame) -> DataFrame:
    """One row per charge with the context of its shipment and carrier (both LEFT joins)."""
    context = shipment_view(shipments).select(
        "shipment_id", "carrier_id", "facility", "base_freight_usd", "risk_score", "risk_tier"
    )
    lines = charge_view(charges).select(
        "charge_id", "shipment_id", "accessorial_type", "accessorial_charge_usd", "risk_flag",
        "ship_date", "disputed",
    )
    keys = shipments.select(F.col("CarrierId").alias("carrier_id"))
    joined = with_used_carrier(lines.join(context, "shipment_id", "left"), carriers, keys)
    return joined.drop("carrier_id").withColumn(
        "total_cost_usd",
        zero_if_null("base_freight_usd") + zero_if_null("accessorial_charge_usd"),
    )


def with_default_type(df: DataFrame) -> DataFrame:
    """``accessorial_type`` is ``Unknown`` where the source has no such column."""
    if "accessorial_type" in df.columns:
        return df
    return df.withColumn("accessorial_type", F.lit("Unknown"))
