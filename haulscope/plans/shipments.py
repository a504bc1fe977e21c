"""Shipment list and detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions import risk
from haulscope.operators import filters, ranges, ranking
from haulscope.operators.enrich import (
    carrier_names, shipment_view, with_carrier, with_used_carrier,
)
from haulscope.operators.filters import Selection
from haulscope.operators.joins import join_measured
from haulscope.plans.scope import EVERYTHING, shipments_in, split_by
from haulscope.sources.tables import FreightTables

LIST_COLUMNS = (
    "shipment_id", "ship_date", "carrier", "facility", "weight_lbs", "miles", "risk_score",
    "risk_tier", "base_freight_usd", "accessorial_charge_usd",
)


def named_shipments(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    """All logical columns of the selected shipments, with the carrier name."""
    if not chosen.carriers:
        view = shipments_in(tables, chosen)
        return with_used_carrier(view, tables.carriers).drop("carrier_id")
    # The chosen carriers' names do both: they select the rows and name them.
    view = shipment_view(tables.shipments).where(chosen.on_shipment())
    names = carrier_names(tables.carriers).where(chosen.on_carrier())
    return join_measured(view, names, "carrier_id", "inner").drop("carrier_id")


def latest_shipments(tables: FreightTables, rows: int = 1000) -> DataFrame:
    """The newest shipments; the limit comes before the join to the carriers."""
    newest = ranking.latest(shipment_view(tables.shipments), rows, "shipment_id")
    named = with_carrier(newest, tables.carriers).drop("carrier_id")
    return named.orderBy(F.desc_nulls_last("ship_date"), "shipment_id")


def shipment_list(tables: FreightTables, chosen: Selection = EVERYTHING) -> DataFrame:
    return named_shipments(tables, chosen).select(*LIST_COLUMNS)


def search(tables: FreightTables, needle: str, chosen: Selection = EVERYTHING, mode: str = "regex") -> DataFrame:
    """Searched before the carriers are joined."""
    found = filters.search_id(shipments_in(tables, chosen), needle, mode)
    return with_used_carrier(found, tables.carriers).select(*LIST_COLUMNS)


def lookup(tables: FreightTables, shipment_id: str) -> DataFrame:
    found = filters.lookup(shipment_view(tables.shipments), shipment_id)
    return with_carrier(found, tables.carriers).select(*LIST_COLUMNS, "lane", "total_cost_usd")


def page(tables: FreightTables, number: int, size: int = 25) -> DataFrame:
    """A page by its number. All rows up to it meet in one task: for the first pages only; readers
    that go on use ``page_after``."""
    shown = ranking.page(shipment_view(tables.shipments), number, size)
    return with_carrier(shown, tables.carriers).select(*LIST_COLUMNS)


def page_after(tables: FreightTables, shipment_id: str, size: int = 25) -> DataFrame:
    """The page that follows a shipment; its cost does not depend on how deep it lies."""
    shown = ranking.page_after(shipment_view(tables.shipments), shipment_id, size)
    return with_carrier(shown, tables.carriers).select(*LIST_COLUMNS)


def page_index(tables: FreightTables, size: int = 25) -> ranges.PageIndex:
    """All shipments of the list in the order of their ids, for pages at any depth."""
    listed = with_carrier(shipment_view(tables.shipments), tables.carriers).select(*LIST_COLUMNS)
    return ranges.page_index(listed, "shipment_id", size=size)


def similar(tables: FreightTables, rows: int = 10, same_facility: bool = False) -> DataFrame:
    return ranking.similar_shipments(
        shipment_view(tables.shipments), tables.carriers, rows, same_facility
    )


def risk_factors(
    tables: FreightTables,
    watched_carriers: Sequence[str] = risk.WATCHED_CARRIERS,
    watched_places: Sequence[str] = risk.WATCHED_PLACES,
) -> DataFrame:
    """Factors of every shipment.

    Only whether a carrier is watched matters, so no more than the watched carriers are joined.
    """
    watched = carrier_names(tables.carriers).where(F.col("carrier").isin(list(watched_carriers)))
    view = join_measured(shipment_view(tables.shipments), watched, "carrier_id", "left")
    return ranking.risk_factors(view, watched_carriers, watched_places)


def recommended_actions(tables: FreightTables) -> DataFrame:
    return ranking.recommended_actions(shipment_view(tables.shipments))


def used_carriers(tables: FreightTables) -> DataFrame:
    """Carrier names that shipments use, sorted: ids are made distinct before the join."""
    used = tables.shipments.select(F.col("CarrierId").alias("carrier_id")).distinct()
    return filters.distinct_values(used.join(carrier_names(tables.carriers), "carrier_id"), "carrier")


def filter_options(tables: FreightTables) -> DataFrame:
    """Every option of the filter lists as (field, option), and the span of dates as text.

    Shipments are scanned once: they are grouped by carrier id and facility, and the lists and
    the span are read off that small result.
    """
    day = "yyyy-MM-dd"
    groups = (
        shipment_view(tables.shipments)
        .groupBy("carrier_id", "facility")
        .agg(F.min("ship_date").alias("first"), F.max("ship_date").alias("last"))
        .join(carrier_names(tables.carriers), "carrier_id", "left")
    )
    unknown = F.lit(None).cast("timestamp_ntz")

    def entry(field: str, option: Column, first: Column = unknown, last: Column = unknown) -> Column:
        return F.struct(
            F.lit(field).alias("field"), option.alias("option"),
            first.alias("first"), last.alias("last"),
        )

    entries = groups.select(
        F.inline(
            F.array(
                entry("carrier", F.col("carrier")),
                entry("facility", F.col("facility")),
                entry("min_date", F.lit(""), first=F.col("first")),
                entry("max_date", F.lit(""), last=F.col("last")),
            )
        )
    ).where(F.col("option").isNotNull())
    grouped = entries.groupBy("field", "option").agg(
        F.date_format(F.coalesce(F.min("first"), F.max("last")), day).alias("date")
    )
    listed = grouped.select("field", F.coalesce("date", "option").alias("option"))
    types = tables.charges.where(F.col("charge_type").isNotNull()).select(
        F.lit("accessorial_type").alias("field"), F.col("charge_type").alias("option")
    )
    return listed.unionByName(types.distinct())


def matched_counts(tables: FreightTables, chosen: Selection) -> DataFrame:
    """Rows shown and rows in all."""
    halves = split_by(tables, chosen)
    shown = F.sum(F.when(F.col("inside"), F.col("n_rows")))
    return halves.agg(
        F.coalesce(shown, F.lit(0)).alias("shown"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"),
    )
