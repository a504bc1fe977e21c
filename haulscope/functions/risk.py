"""Risk tiers, bands, brackets, factor weights and recommended actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from haulscope.functions.numeric import ColumnLike, as_col, half_even, thousands

# Tier thresholds (inclusive lower bounds).
HIGH_FROM = 0.67
MEDIUM_FROM = 0.34


def tier(score: ColumnLike) -> Column:
    """An unknown score is Low: both comparisons fail."""
    score = as_col(score)
    return (
        F.when(score >= HIGH_FROM, F.lit("High"))
        .when(score >= MEDIUM_FROM, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def tier_rank(tier_name: ColumnLike) -> Column:
    tier_name = as_col(tier_name)
    return F.when(tier_name == "Low", 0).when(tier_name == "Medium", 1).when(tier_name == "High", 2)


def high_share_band(percent_high: ColumnLike) -> Column:
    percent_high = as_col(percent_high)
    return (
        F.when(percent_high > 40, F.lit("high"))
        .when(percent_high > 25, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


# Upper edges of the ten score brackets, closed on the right.
BRACKET_EDGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def score_bracket(score: ColumnLike) -> Column:
    """Bracket 0..9; 0.0 falls in the first, NULL and values outside [0, 1] in none."""
    score = as_col(score)
    chain = F.when(score < 0, F.lit(None).cast("int"))
    for index, upper in enumerate(BRACKET_EDGES):
        chain = chain.when(score <= upper, F.lit(index))
    return chain


def bracket_label(index: ColumnLike) -> Column:
    low = as_col(index).cast("int") * 10
    return F.concat(low.cast("string"), F.lit("–"), (low + 10).cast("string"), F.lit("%"))


def bracket_band(index: ColumnLike) -> Column:
    """Band of a 10 % bracket by its lower bound."""
    low = as_col(index).cast("int") * 10
    return F.when(low >= 67, F.lit("high")).when(low >= 34, F.lit("medium")).otherwise(F.lit("low"))


# Names watched for in the factor breakdown.
WATCHED_CARRIERS = ("Werner Enterprises", "XPO Logistics")
WATCHED_PLACES = ("Memphis", "Chicago")

# Base weight of carrier and facility, surcharge and rebate, and for the
# measured inputs (full scale, weight at full scale).
CARRIER_BASE, FACILITY_BASE, WATCHED_PLUS, UNWATCHED_MINUS = 0.30, 0.25, 0.10, -0.05
FULL_MILES, FULL_WEIGHT, FULL_FREIGHT = 5000.0, 44000.0, 5000.0
MILES_WEIGHT, LOAD_WEIGHT, FREIGHT_WEIGHT = 0.20, 0.15, 0.10


def _capped(value: Column, cap: float) -> Column:
    # least() skips NULL, which would turn an unknown value into the cap.
    return F.when(value.isNotNull(), F.least(value, F.lit(cap)))


def factor_weights(
    watched_carriers: Sequence[str] = WATCHED_CARRIERS,
    watched_places: Sequence[str] = WATCHED_PLACES,
) -> list[tuple[str, Column]]:
    """The five (factor, weight) pairs of a shipment, weights rounded to 2 digits."""
    carrier_hit = F.coalesce(F.col("carrier").isin(list(watched_carriers)), F.lit(False))
    place_hit = F.lit(False)
    for place in watched_places:
        place_hit = place_hit | F.coalesce(F.contains("facility", F.lit(place)), F.lit(False))

    def watched(hit: Column, base: float) -> Column:
        return F.when(hit, F.lit(base + WATCHED_PLUS)).otherwise(F.lit(base + UNWATCHED_MINUS))

    miles = _capped(F.col("miles") / FULL_MILES, 1.0) * MILES_WEIGHT
    load = _capped(F.col("weight_lbs") / FULL_WEIGHT, 1.0) * LOAD_WEIGHT
    freight = _capped(F.col("base_freight_usd") / FULL_FREIGHT * FREIGHT_WEIGHT, FREIGHT_WEIGHT)
    raw = [
        ("Carrier History", watched(carrier_hit, CARRIER_BASE)),
        ("Facility Profile", watched(place_hit, FACILITY_BASE)),
        ("Miles / Distance", miles),
        ("Shipment Weight", load),
        ("Base Freight Rate", freight),
    ]
    return [(name, half_even(weight, 2)) for name, weight in raw]


def recommended_actions(tier_name: ColumnLike, exposure: ColumnLike) -> Column:
    """Ordered advice of a shipment as ``array<string>``; texts are fixed values."""
    tier_name, exposure = as_col(tier_name), as_col(exposure)

    def money(factor: float | None = None) -> Column:
        return F.concat(F.lit("$"), thousands(exposure if factor is None else exposure * factor))

    high = F.array(
        F.lit(
            "Consider an alternative carrier with a lower historical detention rate for this lane."
        ),
        F.lit(
            "Request an early morning appointment window (before 10:00 AM) to reduce wait time risk."
        ),
        F.concat(
            F.lit("Add an accessorial buffer of "), money(0.8), F.lit(" – "), money(1.2),
            F.lit(" to your quote."),
        ),
        F.lit("Confirm facility appointment and ensure dock availability before dispatch."),
    )
    medium = F.array(
        F.lit("Monitor appointment confirmation — delays increase detention likelihood."),
        F.concat(
            F.lit("Consider a "), money(0.5), F.lit(" – "), money(),
            F.lit(" contingency buffer in your pricing."),
        ),
        F.lit("Verify carrier's recent performance on similar lanes."),
    )
    low = F.array(
        F.lit("Low risk profile — standard operating procedure applies."),
        F.lit("No additional accessorial buffer needed for this load."),
    )
    return F.when(tier_name == "High", high).when(tier_name == "Medium", medium).otherwise(low)


# Weights, clip and rounding of the rule score.
SCORE_LOAD, SCORE_MILES, SCORE_FLOOR, SCORE_CEILING = 0.3, 0.4, 0.05, 0.98


def rule_score(weight: ColumnLike, miles: ColumnLike, noise: Column | None = None) -> Column:
    """Clipped weighted sum; unlike the factor breakdown, the inputs are not capped."""
    raw = (
        as_col(weight) / FULL_WEIGHT * SCORE_LOAD + as_col(miles) / FULL_MILES * SCORE_MILES
    )
    if noise is not None:
        raw = raw + noise
    return half_even(F.least(F.greatest(raw, F.lit(SCORE_FLOOR)), F.lit(SCORE_CEILING)), 3)
