"""Latest rows, top lists, pages, and per-shipment or per-carrier rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haulscope.functions import risk
from haulscope.functions.numeric import half_even, ratio
from haulscope.operators.enrich import carrier_names
from haulscope.operators.joins import join_measured
from haulscope.session import settle

def latest(df: DataFrame, rows: int, *ties: str, date: str = "ship_date") -> DataFrame:
    """The ``rows`` newest rows; each task keeps its own top rows before anything moves."""
    return df.orderBy(F.desc_nulls_last(date), *[F.asc(t) for t in ties]).limit(rows)


def context_of(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """LEFT join of a top-n result to a large table (runs jobs: see ``join_measured``).

    The few rows are computed once. The large side is first cut to their keys, in place while
    the keys fit a broadcast, so it is not shuffled for the sake of a handful of rows.
    """
    found = settle(few)
    wanted = found.select(key).where(F.col(key).isNotNull()).distinct()
    return found.join(join_measured(many, wanted, key, "left_semi"), key, "left")


def top_charges(lines: DataFrame, rows: int = 15) -> DataFrame:
    return (
        lines.where(F.col("accessorial_charge_usd") > 0)
        .orderBy(
            F.desc("accessorial_charge_usd"), "charge_id", "ship_date", "accessorial_type"
        )
        .limit(rows)
    )


def sort_by(df: DataFrame, column: str, ascending: bool = True, key: str = "shipment_id") -> DataFrame:
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(order, key)


def page(df: DataFrame, number: int, size: int = 25, key: str = "shipment_id") -> DataFrame:
    """Page ``number`` (from 1) in key order. Work grows with the page number: see ``page_after``."""
    return df.orderBy(key).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_key: str, size: int = 25, key: str = "shipment_id") -> DataFrame:
    """The page that follows ``last_key``; costs the same for every page."""
    return df.where(F.col(key) > last_key).orderBy(key).limit(size)


SIMILAR_COLUMNS = (
    "shipment_id", "ship_date", "facility", "risk_score", "risk_tier", "accessorial_charge_usd"
)


def similar_shipments(
    view: DataFrame, carriers: DataFrame, rows: int = 10, same_facility: bool = False
) -> DataFrame:
    """The newest ``rows`` shipments of every carrier (and facility, if asked), ranked.

    Ranked per carrier id first, where Spark keeps only the top rows of each task before the
    shuffle, however much one carrier holds. Names are joined to those few rows and ranked
    again, since several ids may share a name.
    """
    groups = ("facility",) if same_facility else ()
    newest = [F.desc_nulls_last("ship_date"), F.asc("shipment_id")]

    def best(df: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
        return df.withColumn("place", place).where(F.col("place") <= rows)

    known = view.where(F.col("carrier_id").isNotNull()).select("carrier_id", *SIMILAR_COLUMNS)
    for group in groups:
        known = known.where(F.col(group).isNotNull())
    per_id = best(known, "carrier_id", *groups).drop("place")
    names = carrier_names(carriers).where(F.col("carrier").isNotNull())
    return best(per_id.join(names, "carrier_id").drop("carrier_id"), "carrier", *groups)


def similar_to(df: DataFrame, carrier: str, rows: int = 10, facility: str | None = None) -> DataFrame:
    """The same list for one carrier: a filter and a top-k."""
    same = F.col("carrier") == carrier
    if facility is not None:
        same = same & (F.col("facility") == facility)
    return latest(df.where(same).select(*SIMILAR_COLUMNS), rows, "shipment_id")


def risk_factors(
    df: DataFrame,
    watched_carriers: Sequence[str] = risk.WATCHED_CARRIERS,
    watched_places: Sequence[str] = risk.WATCHED_PLACES,
) -> DataFrame:
    """Five rows per shipment: factor, weight, share of the sum, rank.

    Ranked inside the row by sorting a five-element array, so nothing is shuffled. Ties keep
    the order of declaration; unknown weights come last and leave the shares unknown. The outer
    explode spares the size filter that Spark would otherwise evaluate the array for.
    """
    weights = risk.factor_weights(watched_carriers, watched_places)
    entries = F.array(
        *[
            F.struct(
                weight.isNull().alias("unknown"),
                (-weight).alias("descending"),
                F.lit(position).alias("position"),
                F.lit(name).alias("factor"),
                weight.alias("weight"),
            )
            for position, (name, weight) in enumerate(weights)
        ]
    )
    rows = df.select("shipment_id", F.sort_array(entries).alias("entries"))
    whole: Column = F.lit(0.0)
    for position in range(len(weights)):
        whole = whole + F.element_at("entries", position + 1)["weight"]
    listed = rows.select("shipment_id", whole.alias("whole"), F.posexplode_outer("entries"))
    safe_whole = F.when(F.col("whole") == 0, F.lit(1.0)).otherwise(F.col("whole"))
    return listed.select(
        "shipment_id",
        (F.col("pos") + 1).alias("factor_rank"),
        F.col("col.factor").alias("factor"),
        F.col("col.weight").alias("weight"),
        half_even(ratio(F.col("col.weight"), safe_whole) * 100, 4).alias("share_pct"),
    )


def recommended_actions(df: DataFrame) -> DataFrame:
    """One row per shipment and step of advice."""
    advice = risk.recommended_actions("risk_tier", "accessorial_charge_usd")
    return df.select("shipment_id", "risk_tier", F.posexplode_outer(advice)).select(
        "shipment_id", "risk_tier", (F.col("pos") + 1).alias("step"), F.col("col").alias("action")
    )
