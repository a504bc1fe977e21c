"""Operations overview and risk dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from haulscope.functions.dates import week_start
from haulscope.functions.numeric import half_even, zero_if_null
from haulscope.operators import metrics
from haulscope.operators.filters import Selection
from haulscope.operators.rollups import shipment_rollup
from haulscope.plans.scope import EVERYTHING, per_carrier, shipments_in, split_by
from haulscope.sources.tables import FreightTables


def operations_kpis(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.operations_kpis(shipment_rollup(shipments_in(tables, chosen)))


def weekly_rollup(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    """Partial sums of shipments per week."""
    view = shipments_in(tables, chosen).where(F.col("ship_date").isNotNull())
    return shipment_rollup(view.withColumn("week", week_start("ship_date")), "week")


def weekly_operations(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.weekly_operations(weekly_rollup(tables, chosen))


def week_over_week(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return changes_by_week(weekly_rollup(tables, chosen))


def changes_by_week(rollup: DataFrame) -> DataFrame:
    """KPIs of each week and their change from the calendar week before; NULL if that has no rows.

    The window runs over one row per week. The sum of scores is cut to six digits: the last bits depend
    on how the rows were grouped before.
    """
    risk = F.rint(F.col("risk_sum") * 1e6) / 1e6
    weekly = rollup.select(
        "week",
        F.col("n_rows").alias("shipments"),
        half_even(F.try_divide(risk, F.col("n_risk").cast("double")) * 100, 4).alias("avg_risk_pct"),
        F.col("n_high").alias("high_risk"),
        (zero_if_null("acc_cents") / F.lit(100.0)).alias("accessorial_cost"),
    )
    previous = W.orderBy("week")
    kpis = ("shipments", "avg_risk_pct", "high_risk", "accessorial_cost")
    adjoining = F.lag("week").over(previous) == F.col("week") - F.expr("INTERVAL 7 DAYS")
    changes = {
        f"{k}_change": F.when(
            adjoining, half_even((F.col(k) - F.lag(k).over(previous)).cast("double"), 4)
        )
        for k in kpis
    }
    return weekly.withColumns(changes).orderBy("week")


def cost_per_mile_by_carrier(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.carrier_cpm(per_carrier(tables, chosen))


def cost_breakdown_by_carrier(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.carrier_cost_breakdown(per_carrier(tables, chosen))


def risk_kpis(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.risk_kpis(shipment_rollup(shipments_in(tables, chosen)))


def risk_kpis_delta(tables: FreightTables, chosen: Selection) -> DataFrame:
    """The KPIs of a selection and their distance from all shipments, from one scan."""
    halves = split_by(tables, chosen)
    figures = ("n_rows", "risk_sum", "n_risk", "n_high", "acc_cents")
    both = halves.agg(
        *[F.coalesce(F.sum(F.when(F.col("inside"), F.col(f))), F.lit(0)).alias(f) for f in figures],
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f"all_{f}") for f in figures],
    )
    risk = F.try_divide(F.col("risk_sum"), F.col("n_risk").cast("double")) * 100
    all_risk = F.try_divide(F.col("all_risk_sum"), F.col("all_n_risk").cast("double")) * 100
    empty = F.col("n_rows") == 0
    return both.select(
        F.col("n_rows").alias("shipments"),
        F.when(empty, 0.0).otherwise(half_even(risk, 4)).alias("avg_risk_pct"),
        F.col("n_high").alias("high_risk"),
        (F.col("acc_cents") / F.lit(100.0)).alias("accessorial_cost"),
        (F.col("n_rows") - F.col("all_n_rows")).alias("shipments_delta"),
        F.when(empty, 0.0).otherwise(half_even(risk - all_risk, 4)).alias("avg_risk_pct_delta"),
        (F.col("n_high") - F.col("all_n_high")).alias("high_risk_delta"),
        ((F.col("acc_cents") - F.col("all_acc_cents")) / F.lit(100.0)).alias("accessorial_cost_delta"),
    )


def risk_histogram(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return metrics.risk_histogram(shipments_in(tables, chosen))


def risk_by_carrier(
    tables: FreightTables, chosen: Selection = EVERYTHING, top: int | None = None
) -> DataFrame:
    return metrics.carrier_risk(per_carrier(tables, chosen), top)
