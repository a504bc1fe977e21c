"""Carrier comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from haulscope.operators import metrics
from haulscope.operators.filters import only_carriers
from haulscope.plans.scope import per_carrier
from haulscope.sources.tables import FreightTables


def carrier_metrics(tables: FreightTables, carriers: Sequence[str] | None = None) -> DataFrame:
    """Metrics per carrier; ``carriers=[]`` compares nothing, ``None`` everything."""
    rollup = per_carrier(tables)
    if carriers is not None:
        rollup = only_carriers(rollup, carriers)
    return metrics.carrier_metrics(rollup)


def carrier_summary(tables: FreightTables, carriers: Sequence[str] | None = None) -> DataFrame:
    return metrics.carrier_summary(carrier_metrics(tables, carriers))


def carrier_ranking(
    tables: FreightTables, measure: str, carriers: Sequence[str] | None = None
) -> DataFrame:
    return metrics.carrier_ranking(carrier_metrics(tables, carriers), measure)


def carrier_radar(tables: FreightTables, carriers: Sequence[str] | None = None) -> DataFrame:
    return metrics.carrier_radar(carrier_metrics(tables, carriers))
