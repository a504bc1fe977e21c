"""Accessorial charge tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.operators import metrics
from haulscope.operators.enrich import charge_view, shipment_view, with_carrier
from haulscope.functions.numeric import zero_if_null
from haulscope.operators.filters import Selection
from haulscope.operators.ranking import context_of, latest, top_charges
from haulscope.operators.rollups import regroup
from haulscope.plans.scope import CHARGE_TIES, EVERYTHING, charges_in, name_carriers
from haulscope.sources.tables import FreightTables


def accessorial_kpis(
    tables: FreightTables, chosen: Selection = EVERYTHING, grain: str = "charge"
) -> DataFrame:
    """``grain='charge'`` counts the base freight on every charge of a shipment, as the spend
    figure of the tracker does; ``grain='shipment'`` counts it once."""
    rollup = charges_in(tables, chosen)
    if grain == "shipment":
        rollup = rollup.withColumn("total_cents", F.col("total_once_cents"))
    return metrics.accessorial_kpis(regroup(rollup))


def charges_by_type(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    rollup = charges_in(tables, chosen, charge_keys=("accessorial_type",), need_shipment=False, charged_only=True)
    found = rollup.where(F.col("accessorial_type").isNotNull())
    return metrics.charges_by_type(regroup(found, "accessorial_type"))


def weekly_rollup(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    """Partial sums of charges per week."""
    rollup = charges_in(tables, chosen, charge_keys=("week",), need_shipment=False, charged_only=True)
    return regroup(rollup.where(F.col("week").isNotNull()), "week")


def weekly_charges(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.weekly_charges(weekly_rollup(tables, chosen))


def charges_by_carrier(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    rollup = charges_in(tables, chosen, charged_only=True)
    found = rollup.where(F.col("carrier_id").isNotNull())
    per_name = name_carriers(regroup(found, "carrier_id"), tables)
    return metrics.charges_by(per_name, "carrier")


def charges_by_facility(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    rollup = charges_in(tables, chosen, charged_only=True)
    found = rollup.where(F.col("facility").isNotNull())
    return metrics.charges_by(regroup(found, "facility"), "facility")


def tier_outcomes(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    rollup = charges_in(tables, chosen).where(F.col("risk_tier").isNotNull())
    return metrics.tier_outcomes(regroup(rollup, "risk_tier"))


def _with_context(few: DataFrame, tables: FreightTables) -> DataFrame:
    context = shipment_view(tables.shipments).select(
        "shipment_id", "carrier_id", "facility", "base_freight_usd", "risk_score", "risk_tier"
    )
    joined = with_carrier(context_of(few, context, "shipment_id"), tables.carriers)
    return joined.drop("carrier_id").withColumn(
        "total_cost_usd",
        zero_if_null("base_freight_usd") + zero_if_null("accessorial_charge_usd"),
    )


LINE_COLUMNS = (
    "charge_id", "shipment_id", "accessorial_type", "accessorial_charge_usd", "risk_flag",
    "ship_date", "disputed",
)
LINE_TIES = ("charge_id", "accessorial_charge_usd", "accessorial_type", "risk_flag")


def latest_charges(tables: FreightTables, rows: int = 2000) -> DataFrame:
    return latest(tables.charges, rows, *CHARGE_TIES, date="invoice_date")


def latest_charge_lines(tables: FreightTables, rows: int = 2000) -> DataFrame:
    """The newest charges with their context. The limit comes before the joins."""
    lines = charge_view(tables.charges).select(*LINE_COLUMNS)
    return _with_context(latest(lines, rows, *LINE_TIES), tables)


def top_charge_lines(tables: FreightTables, rows: int = 15) -> DataFrame:
    lines = charge_view(tables.charges).select(
        "charge_id", "shipment_id", "ship_date", "accessorial_type", "accessorial_charge_usd"
    )
    shown = _with_context(top_charges(lines, rows), tables)
    return shown.select(
        "charge_id", "shipment_id", "ship_date", "carrier", "facility", "accessorial_type",
        "accessorial_charge_usd", "base_freight_usd", "total_cost_usd", "risk_tier",
    ).orderBy(F.desc("accessorial_charge_usd"), "charge_id", "ship_date", "accessorial_type")
