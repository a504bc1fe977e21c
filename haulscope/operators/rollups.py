"""Partial sums that can be grouped again.

A rollup keeps sums, counts and maxima per key, so a metric by carrier name can first be
summed per carrier *id* (map-side, no join), then joined to the few names, then summed again.
The same goes for charges: one row per shipment before the big join, whatever the number
of charges on a shipment. Columns a metric does not use are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions.numeric import cents, count_where, dollars, ratio, zero_if_null

MAXIMA = ("max_charged_cents",)


def shipment_rollup(view: DataFrame, *keys: str) -> DataFrame:
    is_charged = F.col("accessorial_charge_usd") > 0
    return view.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("shipment_id").alias("n_ids"),
        F.sum(cents("base_freight_usd")).alias("base_cents"),
        F.count("base_freight_usd").alias("n_base"),
        F.sum(cents("accessorial_charge_usd")).alias("acc_cents"),
        F.count("accessorial_charge_usd").alias("n_acc"),
        count_where(is_charged).alias("n_charged"),
        F.sum(cents("total_cost_usd")).alias("total_cents"),
        F.count("total_cost_usd").alias("n_total"),
        F.sum("cost_per_mile").alias("cpm_sum"),
        F.count("cost_per_mile").alias("n_cpm"),
        F.sum("miles").alias("miles_sum"),
        F.count("miles").alias("n_miles"),
        F.sum("weight_lbs").alias("weight_sum"),
        F.count("weight_lbs").alias("n_weight"),
        F.sum("risk_score").alias("risk_sum"),
        F.count("risk_score").alias("n_risk"),
        count_where(F.col("risk_tier") == "High").alias("n_high"),
    )


def charge_rollup(view: DataFrame, *keys: str) -> DataFrame:
    amount = F.col("accessorial_charge_usd")
    charged_cents = F.when(amount > 0, cents(amount))
    return view.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("shipment_id").alias("n_ids"),
        F.sum(cents(amount)).alias("acc_cents"),
        F.count(amount).alias("n_acc"),
        F.count(charged_cents).alias("n_charged"),
        F.sum(charged_cents).alias("charged_cents"),
        F.max(charged_cents).alias("max_charged_cents"),
    )


def spread_base(rollup: DataFrame) -> DataFrame:
    """Add base and total of a charge rollup joined to its shipments.

    At the grain of charges the base freight repeats on every charge of the shipment.
    ``*_once`` count it once, at the grain of shipments.
    """
    base = cents("base_freight_usd")
    known = F.col("base_freight_usd").isNotNull()
    repeated = base * F.col("n_rows")
    return rollup.withColumns(
        {
            "base_cents": repeated,
            "n_base": F.when(known, F.col("n_rows")).otherwise(F.lit(0)),
            "total_cents": zero_if_null(repeated) + zero_if_null("acc_cents"),
            "base_once_cents": base,
            "total_once_cents": zero_if_null(base) + zero_if_null("acc_cents"),
        }
    )


def regroup(rollup: DataFrame, *keys: str) -> DataFrame:
    measures = [
        name for name in rollup.columns
        if name.startswith("n_") or name.endswith("_cents") or name.endswith("_sum")
    ]
    combined = [
        (F.max(name) if name in MAXIMA else F.sum(name)).alias(name) for name in measures
    ]
    return rollup.groupBy(*keys).agg(*combined)


def total(money_cents: str) -> Column:
    """Sum in dollars; 0 where nothing was summed."""
    return dollars(zero_if_null(money_cents))


def mean_money(money_cents: str, count: str) -> Column:
    return ratio(dollars(money_cents), count)


def mean(sum_name: str, count: str) -> Column:
    """Mean of doubles. Cut to 6 digits: the last bits depend on the order of summing."""
    return F.rint(ratio(sum_name, count) * 1e6) / 1e6


def how_many(count: str) -> Column:
    return zero_if_null(count)
