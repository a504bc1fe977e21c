"""Weekly series that are kept up to date: each delivery's rollup is stored, old rows are not read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from haulscope.operators import metrics
from haulscope.operators.rollups import regroup
from haulscope.plans import accessorials, overview
from haulscope.sources import stored
from haulscope.sources.tables import FreightTables


@dataclass(frozen=True)
class KeptWeeks:
    """Rollups of deliveries in ``folder``, a row for each delivery and week.

    Rollups can be grouped again, so rows that come late, for weeks that are there already, need nothing
    special. A delivery counts once, however often it is added (see ``stored.append_once``). Rows are
    added, never taken back: a corrected shipment belongs in a table with upserts.
    """

    spark: SparkSession
    folder: str

    def add(self, delivery: FreightTables, load_id: str) -> bool:
        """Add a delivery's shipments and charges; False if both were there."""
        shipments = overview.weekly_rollup(delivery)
        charges = accessorials.weekly_rollup(delivery)
        added = stored.append_once(shipments, f"{self.folder}/shipments", load_id)
        return stored.append_once(charges, f"{self.folder}/charges", load_id) or added

    def shipments(self) -> DataFrame:
        """One rollup row a week over all deliveries."""
        return regroup(stored.read_loads(self.spark, f"{self.folder}/shipments"), "week")

    def charges(self) -> DataFrame:
        return regroup(stored.read_loads(self.spark, f"{self.folder}/charges"), "week")

    def weekly_operations(self) -> DataFrame:
        return metrics.weekly_operations(self.shipments())

    def week_over_week(self) -> DataFrame:
        return overview.changes_by_week(self.shipments())

    def weekly_charges(self) -> DataFrame:
        return metrics.weekly_charges(self.charges())
