"""Row filters. An empty list means "no filter", except in ``only_carriers``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions.numeric import ColumnLike, as_col


def _midnight(day: date | str) -> Column:
    if isinstance(day, str):
        day = date.fromisoformat(day)
    if not isinstance(day, datetime):
        day = datetime.combine(day, time.min)
    return F.lit(day.isoformat(sep=" ")).cast("timestamp_ntz")


def in_dates(column: ColumnLike, start: date | str | None, end: date | str | None) -> Column | None:
    """Both ends inclusive, the end at its midnight; no filter unless both are given."""
    if start is None or end is None:
        return None
    column = as_col(column)
    return (column >= _midnight(start)) & (column <= _midnight(end))


def in_list(column: ColumnLike, values: Sequence[str]) -> Column | None:
    return as_col(column).isin(list(values)) if values else None


@dataclass(frozen=True)
class Selection:
    """What a page is filtered to."""

    start: date | str | None = None
    end: date | str | None = None
    carriers: Sequence[str] = ()
    facilities: Sequence[str] = ()
    tiers: Sequence[str] = ()
    charge_types: Sequence[str] = ()

    def on_shipment(self) -> Column:
        """Everything a shipment row can decide itself, that is all but the carrier name."""
        return _all(
            in_dates("ship_date", self.start, self.end),
            in_list("facility", self.facilities),
            in_list("risk_tier", self.tiers),
        )

    def on_charge(self) -> Column:
        return _all(
            in_dates("ship_date", self.start, self.end),
            in_list("accessorial_type", self.charge_types),
        )

    def on_carrier(self) -> Column:
        return _all(in_list("carrier", self.carriers))


def _all(*conditions: Column | None) -> Column:
    present = [c for c in conditions if c is not None]
    return reduce(and_, present) if present else F.lit(True)


def only_carriers(df: DataFrame, carriers: Sequence[str]) -> DataFrame:
    """Comparison filter: an empty list selects nothing."""
    return df.where(F.col("carrier").isin(list(carriers)) if carriers else F.lit(False))


def search_id(df: DataFrame, needle: str, mode: str = "regex") -> DataFrame:
    """Ids that contain the upper-cased needle, as a pattern or literally."""
    identifier = F.col("shipment_id").cast("string")
    if mode == "literal":
        return df.where(F.contains(identifier, F.lit(needle.upper())))
    return df.where(identifier.rlike(needle.upper()))


def lookup(df: DataFrame, shipment_id: str) -> DataFrame:
    """The newest shipment of that id, or no row."""
    found = df.where(F.col("shipment_id") == shipment_id)
    return found.orderBy(F.desc_nulls_last("ship_date")).limit(1)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
