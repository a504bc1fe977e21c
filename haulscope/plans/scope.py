"""Rollups of the rows a selection leaves, shared by all plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.functions.dates import week_start
from haulscope.operators.enrich import carrier_names, charge_view, shipment_view
from haulscope.operators.filters import Selection
from haulscope.operators.joins import join_measured
from haulscope.operators.ranking import latest
from haulscope.operators.rollups import charge_rollup, regroup, shipment_rollup, spread_base
from haulscope.sources.tables import FreightTables

EVERYTHING = Selection()

# Order of charges of the same date.
CHARGE_TIES = ("charge_id", "amount", "charge_type", "risk_flag")


def newest_shipments(tables: FreightTables, rows: int = 1000) -> FreightTables:
    """The bundle with only its newest shipments: a bound on the rows a model is trained on."""
    newest = latest(tables.shipments, rows, "ShipmentId", date="ShipDate")
    return FreightTables(newest, tables.charges, tables.carriers, tables.facilities)


def shipments_in(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    """Shipments of a selection, carrier still as id."""
    view = shipment_view(tables.shipments).where(chosen.on_shipment())
    return _by_named_carriers(view, tables, chosen)


def _by_named_carriers(view: DataFrame, tables: FreightTables, chosen: Selection) -> DataFrame:
    if not chosen.carriers:
        return view
    named = carrier_names(tables.carriers).where(chosen.on_carrier()).select("carrier_id")
    return join_measured(view, named, "carrier_id", "left_semi")


def name_carriers(rollup: DataFrame, tables: FreightTables, *keys: str) -> DataFrame:
    """Rollup per carrier id -> per carrier name; ids without a name drop out."""
    names = carrier_names(tables.carriers).where(F.col("carrier").isNotNull())
    return regroup(rollup.join(names, "carrier_id"), "carrier", *keys)


def per_carrier(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    view = shipments_in(tables, chosen).where(F.col("carrier_id").isNotNull())
    return name_carriers(shipment_rollup(view, "carrier_id"), tables)


def split_by(tables: FreightTables, chosen: Selection) -> DataFrame:
    """Rollup of all shipments in at most two rows: inside the selection and outside.

    Rows are summed by (carrier id, row filter passed?) in one scan; the carrier names then
    decide which of those few sums belong to the selection.
    """
    view = shipment_view(tables.shipments).withColumn(
        "inside", F.coalesce(chosen.on_shipment(), F.lit(False))
    )
    if not chosen.carriers:
        return shipment_rollup(view, "inside")
    parts = shipment_rollup(view, "carrier_id", "inside")
    named = carrier_names(tables.carriers).where(chosen.on_carrier())
    named = named.select("carrier_id", F.lit(True).alias("wanted")).distinct()
    joined = parts.join(named, "carrier_id", "left")
    return regroup(
        joined.withColumn("inside", F.col("inside") & F.col("wanted").isNotNull()), "inside"
    )


def charges_in(
    tables: FreightTables,
    chosen: Selection = EVERYTHING,
    *,
    charge_keys: tuple[str, ...] = (),
    need_shipment: bool = True,
    charged_only: bool = False,
) -> DataFrame:
    """Charge rollup per shipment (and ``charge_keys``) with the shipment's attributes.

    Charges are summed per shipment id before they meet the shipments: that uses the shuffle
    the join needs anyway, and a shipment with very many charges is one row by then. Charges
    without an amount are left out of that shuffle with ``charged_only``. Without
    ``need_shipment`` (and without a carrier filter) the shipments are not read at all.
    """
    view = charge_view(tables.charges).where(chosen.on_charge())
    if charged_only:
        view = view.where(F.col("accessorial_charge_usd") > 0)
    view = view.withColumn("week", week_start("ship_date"))
    if not need_shipment and not chosen.carriers:
        return charge_rollup(view, *charge_keys)
    rollup = charge_rollup(view, "shipment_id", *charge_keys)
    context = shipment_view(tables.shipments).select(
        "shipment_id", "carrier_id", "facility", "base_freight_usd", "risk_tier"
    )
    if chosen.carriers:
        joined = rollup.join(_by_named_carriers(context, tables, chosen), "shipment_id")
    else:
        joined = rollup.join(context, "shipment_id", "left")
    return spread_base(joined)
