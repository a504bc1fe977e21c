"""Finished metrics, from rollups (see ``haulscope.operators.rollups``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.functions import risk, text
from haulscope.functions.numeric import count_where, half_even, percent, ratio
from haulscope.operators.rollups import how_many, mean, mean_money, total


def by_desc(measure: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(measure), F.asc(key)]


def by_asc(measure: str, key: str) -> list[Column]:
    return [F.asc_nulls_last(measure), F.asc(key)]


# --- fleet-wide -----------------------------------------------------------------------------


def operations_kpis(rollup: DataFrame) -> DataFrame:
    """Revenue is the base freight; the rate is 0 without shipments."""
    return rollup.select(
        how_many("n_rows").alias("shipments"),
        total("base_cents").alias("revenue"),
        total("total_cents").alias("total_cost"),
        total("acc_cents").alias("accessorial_cost"),
        mean("cpm_sum", "n_cpm").alias("avg_cpm"),
        F.coalesce(percent("n_charged", "n_rows"), F.lit(0.0)).alias("accessorial_rate"),
    )


def risk_kpis(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        how_many("n_rows").alias("shipments"),
        F.coalesce(half_even(mean("risk_sum", "n_risk") * 100, 4), F.lit(0.0)).alias("avg_risk_pct"),
        how_many("n_high").alias("high_risk"),
        total("acc_cents").alias("accessorial_cost"),
    )


def fleet_baselines(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        mean("cpm_sum", "n_cpm").alias("avg_cpm"),
        mean_money("total_cents", "n_total").alias("avg_total"),
    )


# --- weekly ---------------------------------------------------------------------------------


def weekly_operations(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "week",
        how_many("n_ids").alias("shipments"),
        total("base_cents").alias("revenue"),
        total("total_cents").alias("total_cost"),
    ).orderBy("week")


# --- by lane, origin or destination ---------------------------------------------------------


def lane_metrics(rollup: DataFrame, key: str, min_shipments: int = 2) -> DataFrame:
    """Metrics of each group with at least ``min_shipments`` shipments."""
    finished = rollup.select(
        key,
        how_many("n_ids").alias("shipments"),
        mean_money("total_cents", "n_total").alias("avg_cost"),
        total("total_cents").alias("total_cost"),
        mean("cpm_sum", "n_cpm").alias("avg_cpm"),
        mean("miles_sum", "n_miles").alias("avg_miles"),
        mean("risk_sum", "n_risk").alias("avg_risk"),
        total("acc_cents").alias("accessorial_cost"),
        how_many("n_high").alias("high_risk_count"),
    )
    return finished.where(F.col("shipments") >= min_shipments).withColumns(
        {
            "accessorial_rate": percent("accessorial_cost", "total_cost"),
            "high_risk_pct": percent("high_risk_count", "shipments"),
        }
    )


def lane_extremes(metrics: DataFrame, key: str) -> DataFrame:
    """Group count, busiest, cheapest and dearest group; ties go to the smallest key."""

    def best(measure: str, highest: bool) -> Column:
        sign = -1 if highest else 1
        order = F.when(F.col(measure).isNotNull(), F.struct(F.col(measure) * sign, F.col(key)))
        return F.coalesce(F.min_by(key, order), F.lit(text.DASH))

    found = metrics.agg(
        F.count(F.lit(1)).alias("groups"),
        best("shipments", True).alias("busiest"),
        best("avg_cpm", False).alias("cheapest"),
        best("avg_cpm", True).alias("dearest"),
    )
    shown = {f"{c}_label": text.shorten(c, 29, 27) for c in ("busiest", "cheapest", "dearest")}
    return found.withColumns(shown)


def lane_points(metrics: DataFrame, key: str) -> DataFrame:
    """Volume against cost, sized by spend and coloured by risk."""
    return metrics.select(
        key, "shipments", "avg_cost", "total_cost", "avg_risk", "avg_cpm", "accessorial_rate"
    )


def lane_top(metrics: DataFrame, key: str, rows: int = 8, dearest: bool = True) -> DataFrame:
    order = by_desc("avg_cpm", key) if dearest else by_asc("avg_cpm", key)
    chosen = metrics.orderBy(*order).limit(rows)
    return chosen.select(key, text.shorten(key, 28).alias("label"), "avg_cpm")


def lane_breakdown(metrics: DataFrame, key: str) -> DataFrame:
    """Display table, dearest per mile first."""
    return metrics.select(
        key,
        "shipments",
        half_even("avg_cost", 2).alias("avg_cost"),
        half_even("avg_cpm", 3).alias("avg_cpm"),
        half_even("avg_miles", 0).cast("int").alias("avg_miles"),
        half_even("avg_risk", 3).alias("avg_risk"),
        "accessorial_rate",
        "high_risk_pct",
        "total_cost",
    ).orderBy(*by_desc("avg_cpm", key))


# --- by carrier -----------------------------------------------------------------------------


def carrier_cpm(rollup: DataFrame) -> DataFrame:
    found = rollup.select("carrier", mean("cpm_sum", "n_cpm").alias("cost_per_mile"))
    return found.orderBy(*by_asc("cost_per_mile", "carrier"))


def carrier_cost_breakdown(rollup: DataFrame) -> DataFrame:
    found = rollup.select("carrier", total("base_cents").alias("base"), total("acc_cents").alias("acc"))
    return found.orderBy(*by_desc("base", "carrier"))


def carrier_risk(rollup: DataFrame, top: int | None = None) -> DataFrame:
    """Mean risk, lowest first; with ``top`` the riskiest carriers, highest first."""
    found = rollup.select("carrier", mean("risk_sum", "n_risk").alias("risk_score"))
    found = found.withColumn("risk_pct", half_even(F.col("risk_score") * 100, 1))
    if top is None:
        return found.orderBy(*by_asc("risk_score", "carrier"))
    return found.orderBy(*by_desc("risk_score", "carrier")).limit(top)


def carrier_metrics(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "carrier",
        how_many("n_ids").alias("shipments"),
        mean_money("total_cents", "n_total").alias("avg_cost"),
        total("total_cents").alias("total_spend"),
        mean("cpm_sum", "n_cpm").alias("avg_cpm"),
        mean("risk_sum", "n_risk").alias("avg_risk"),
        how_many("n_high").alias("high_risk_count"),
        total("acc_cents").alias("total_accessorial"),
        mean_money("acc_cents", "n_acc").alias("avg_accessorial"),
        mean("miles_sum", "n_miles").alias("avg_miles"),
        mean("weight_sum", "n_weight").alias("avg_weight"),
    ).withColumns(
        {
            "high_risk_pct": percent("high_risk_count", "shipments"),
            "accessorial_rate": percent("total_accessorial", "total_spend"),
        }
    )


def carrier_summary(metrics: DataFrame) -> DataFrame:
    """Display table, cheapest per mile first."""
    return metrics.select(
        "carrier",
        "shipments",
        half_even("avg_cost", 2).alias("avg_cost"),
        half_even("avg_cpm", 2).alias("avg_cpm"),
        half_even("avg_risk", 2).alias("avg_risk"),
        "high_risk_pct",
        half_even("avg_accessorial", 2).alias("avg_accessorial"),
        "accessorial_rate",
        half_even("total_spend", 2).alias("total_spend"),
        half_even("avg_miles", 0).cast("int").alias("avg_miles"),
        half_even("avg_weight", 0).cast("int").alias("avg_weight"),
    ).orderBy(*by_asc("avg_cpm", "carrier"))


# Measure -> ascending?
CARRIER_ORDERS = {"avg_cpm": True, "high_risk_pct": False, "accessorial_rate": False}


def carrier_ranking(metrics: DataFrame, measure: str) -> DataFrame:
    order = by_asc if CARRIER_ORDERS[measure] else by_desc
    found = metrics.select("carrier", measure)
    if measure == "high_risk_pct":
        found = found.withColumn("band", risk.high_share_band(measure))
    return found.orderBy(*order(measure, "carrier"))


def carrier_radar(metrics: DataFrame) -> DataFrame:
    """Min-max scores of the carriers; a constant measure scores 0.5.

    The bounds are a scalar subquery over the same grouped result, whose shuffle Spark reuses,
    so no window pulls all carriers into one task.
    """
    measures = {
        "cost_score": ("avg_cpm", True),
        "low_risk_score": ("avg_risk", True),
        "accessorial_score": ("accessorial_rate", True),
        "volume_score": ("shipments", False),
    }
    bounds = metrics.agg(
        F.struct(
            *[F.min(m).alias(f"{m}_lo") for m, _ in measures.values()],
            *[F.max(m).alias(f"{m}_hi") for m, _ in measures.values()],
        ).alias("bounds")
    )
    # Bound once: each mention of a subquery is a copy of it in the plan.
    bound = metrics.withColumn("limits", bounds.scalar())
    limits = F.col("limits")

    def score(measure: str, inverted: bool) -> Column:
        low, high = limits[f"{measure}_lo"], limits[f"{measure}_hi"]
        share = ratio(F.col(measure) - low, high - low)
        share = F.lit(1.0) - share if inverted else share
        return F.rint(F.when(low == high, F.lit(0.5)).otherwise(share) * 1e6) / 1e6

    return bound.select("carrier", *[score(*spec).alias(name) for name, spec in measures.items()])


# --- accessorial charges --------------------------------------------------------------------


def accessorial_kpis(rollup: DataFrame) -> DataFrame:
    """Every figure is 0 when there is nothing to divide by."""
    zero = F.lit(0.0)
    return rollup.select(
        total("acc_cents").alias("total_accessorial"),
        how_many("n_charged").alias("charged_rows"),
        how_many("n_rows").alias("total_rows"),
        F.coalesce(percent("n_charged", "n_rows"), zero).alias("accessorial_rate"),
        F.coalesce(mean_money("charged_cents", "n_charged"), zero).alias("avg_charge"),
        total("max_charged_cents").alias("max_charge"),
        F.coalesce(percent(total("acc_cents"), total("total_cents")), zero).alias("pct_of_spend"),
    )


def charges_by_type(rollup: DataFrame) -> DataFrame:
    """Sum, count and share of the whole per charge type, largest first."""
    found = rollup.select(
        "accessorial_type", "charged_cents", how_many("n_charged").alias("count")
    )
    whole = found.agg(F.sum("charged_cents").alias("whole")).scalar()
    return found.select(
        "accessorial_type",
        total("charged_cents").alias("total"),
        "count",
        percent("charged_cents", whole).alias("share_pct"),
    ).orderBy(*by_desc("total", "accessorial_type"))


def charges_by(rollup: DataFrame, key: str) -> DataFrame:
    """Sum, count and mean of the charged rows per ``key``, smallest sum first."""
    return rollup.select(
        key,
        total("charged_cents").alias("total"),
        how_many("n_charged").alias("count"),
        mean_money("charged_cents", "n_charged").alias("avg"),
    ).orderBy(*by_asc("total", key))


def weekly_charges(rollup: DataFrame) -> DataFrame:
    return rollup.select("week", total("charged_cents").alias("total")).orderBy("week")


def tier_outcomes(rollup: DataFrame) -> DataFrame:
    """Outcome per risk tier, Low to High; an unknown amount counts as not charged."""
    return rollup.select(
        "risk_tier",
        how_many("n_ids").alias("count"),
        mean_money("acc_cents", "n_acc").alias("avg_acc"),
        total("acc_cents").alias("total_acc"),
        half_even(ratio("n_charged", "n_rows") * 100, 4).alias("pct_with_acc"),
        mean_money("base_cents", "n_base").alias("avg_base"),
        mean_money("total_cents", "n_rows").alias("avg_total"),
    ).orderBy(risk.tier_rank("risk_tier"), "risk_tier")


# --- distributions --------------------------------------------------------------------------


def risk_histogram(view: DataFrame) -> DataFrame:
    """Ten right-closed score brackets; empty ones stay with 0."""
    counts = view.groupBy(risk.score_bracket("risk_score").alias("bracket")).agg(
        F.count(F.lit(1)).alias("found")
    )
    brackets = view.sparkSession.range(len(risk.BRACKET_EDGES)).select(
        F.col("id").cast("int").alias("bracket")
    )
    return brackets.join(counts, "bracket", "left").select(
        "bracket",
        risk.bracket_label("bracket").alias("label"),
        F.coalesce("found", F.lit(0)).alias("count"),
        risk.bracket_band("bracket").alias("band"),
    ).orderBy("bracket")


def cost_histogram(view: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] of the total cost; the maximum is in the last bin.

    Two narrow scans: the range as a scalar subquery, then the counts. Empty bins stay with 0;
    without any cost there are no bins.
    """
    known = view.where(F.col("total_cost_usd").isNotNull()).select(
        F.col("total_cost_usd").alias("cost")
    )
    span = known.agg(F.struct(F.min("cost").alias("lo"), F.max("cost").alias("hi")).alias("s")).scalar()
    low = F.col("span.lo")
    width = (F.col("span.hi") - low) / F.lit(float(bins))
    position = F.coalesce(F.floor(F.try_divide(F.col("cost") - low, width)), F.lit(0))
    index = F.least(position, F.lit(bins - 1)).cast("int")
    counts = known.withColumn("span", span).groupBy(index.alias("bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("found"))
    every = view.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    spanned = every.withColumn("span", span).where(low.isNotNull())
    return spanned.join(counts, "bin", "left").select(
        "bin",
        half_even(low + F.col("bin") * width, 4).alias("low_edge"),
        half_even(low + (F.col("bin") + 1) * width, 4).alias("high_edge"),
        F.coalesce("found", F.lit(0)).alias("count"),
    ).orderBy("bin")


def estimate_position(view: DataFrame, estimates: list[float]) -> DataFrame:
    """Share of past shipments that cost no more than each estimate, from one pass."""
    known = view.where(F.col("total_cost_usd").isNotNull())
    shares = known.agg(
        F.count(F.lit(1)).alias("history"),
        *[
            count_where(F.col("total_cost_usd") <= F.lit(value)).alias(f"below_{i}")
            for i, value in enumerate(estimates)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(value)).alias("estimate"), F.col(f"below_{i}").alias("below"))
            for i, value in enumerate(estimates)
        ]
    )
    return shares.select("history", F.inline(rows)).select(
        "estimate", "below", "history", percent("below", "history", 4).alias("percentile")
    )
