"""Checks before a model is trained or used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haulscope.functions.numeric import finite, half_even, plain, ratio

# Least training rows, shares that count as severe imbalance and dominance.
LEAST_ROWS = 100
IMBALANCE_SHARE = 0.98
DOMINANCE_SHARE = 0.95


def training_facts(labelled: DataFrame, label: str, carrier: str = "carrier_id") -> DataFrame:
    """One row of counts: all, positive, negative, largest carrier. One scan, one small shuffle."""
    positive = F.col(label).cast("boolean")
    per_carrier = labelled.groupBy(F.col(carrier).alias("who")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(positive, 1)).alias("yes"),
        F.count(F.when(~positive, 1)).alias("no"),
    )
    named = F.col("who").isNotNull()
    top = F.when(named, F.struct(-F.col("n"), F.col("who")))
    return per_carrier.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("yes"), F.lit(0)).alias("yes"),
        F.coalesce(F.sum("no"), F.lit(0)).alias("no"),
        F.min_by("who", top).alias("top_carrier"),
        F.max(F.when(named, F.col("n"))).alias("top_rows"),
    )


def training_guards(facts: DataFrame) -> DataFrame:
    """The four guards with their verdict: rule, severity, triggered, share, message."""
    larger = F.greatest("yes", "no")
    labelled = F.col("yes") + F.col("no")
    imbalance = ratio(larger, labelled)
    dominance = ratio("top_rows", "rows")
    percent_large = half_even(imbalance * 100, 0).cast("int")

    def guard(rule: str, severity: str, failed, share, *message) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        hit = F.coalesce(failed, F.lit(False))
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(severity).alias("severity"),
            hit.alias("triggered"),
            half_even(share, 6).alias("share"),
            F.when(hit, text).alias("message"),
        )

    no_share = F.lit(None).cast("double")
    listed = F.array(
        guard(
            "too_few_rows", "error", F.col("rows") < LEAST_ROWS, no_share,
            f"Minimum {LEAST_ROWS} historical records required. Current: ",
            F.col("rows").cast("string"), ".",
        ),
        guard(
            "one_outcome", "error", (F.col("yes") == 0) | (F.col("no") == 0), no_share,
            "Cannot train model - all records have same outcome. Need both Yes and No examples.",
        ),
        guard(
            "class_imbalance", "warning",
            (imbalance >= IMBALANCE_SHARE) & (F.least("yes", "no") > 0), imbalance,
            "Severe class imbalance detected (", percent_large.cast("string"), "/",
            (100 - percent_large).cast("string"),
            "). Model may have low sensitivity. Consider class weighting.",
        ),
        guard(
            "carrier_dominance", "warning", dominance >= DOMINANCE_SHARE, dominance,
            "Training data dominated by ", F.col("top_carrier").cast("string"), " (",
            half_even(dominance * 100, 0).cast("int").cast("string"),
            "%). Predictions may be unreliable for other carriers.",
        ),
    )
    return facts.select(F.inline(listed))


def refuse_if_blocked(guards: DataFrame) -> None:
    """Raise the first guard of severity error that triggered (collects at most four rows)."""
    blocked = guards.where(F.col("triggered") & (F.col("severity") == "error")).collect()
    if blocked:
        raise ValueError(blocked[0]["message"])


def class_weights(labelled: DataFrame, label: str) -> DataFrame:
    """Balancing weight per class: rows / (classes * rows of the class)."""
    counts = (
        labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    )
    whole = counts.agg(
        F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).alias("whole")
    ).scalar()
    weight = ratio(whole["n"], whole["k"] * F.col("rows"))
    return counts.select(label, "rows", half_even(weight, 6).alias("weight"))


def feature_ranges(training: DataFrame, *features: str) -> DataFrame:
    """One row: minimum and maximum of each feature."""
    return training.agg(
        *[F.min(finite(f)).alias(f"{f}_min") for f in features],
        *[F.max(finite(f)).alias(f"{f}_max") for f in features],
    )


# How a feature is called in a warning.
FEATURE_TITLES = {"miles": "Distance", "weight_lbs": "Weight"}


def range_warnings(new: DataFrame, ranges: DataFrame, *features: str) -> DataFrame:
    """A row per new shipment and feature outside the training range."""
    # Bound once: each mention of a subquery is a copy of it in the plan.
    new = new.withColumn("_limits", ranges.select(F.struct(*ranges.columns).alias("limits")).scalar())
    limits, found = F.col("_limits"), []
    for feature in features:
        value, low, high = F.col(feature), limits[f"{feature}_min"], limits[f"{feature}_max"]

        def warning(side: str, limit) -> Column:
            return F.struct(
                F.lit(feature).alias("feature"),
                value.cast("double").alias("value"),
                limit.alias("limit"),
                F.concat(
                    F.lit(f"{FEATURE_TITLES.get(feature, feature)} "), plain(value),
                    F.lit(f" {side} of "), plain(limit),
                    F.lit(". Prediction reliability reduced."),
                ).alias("message"),
            )

        found.append(
            F.when(value > high, warning("exceeds training maximum", high)).when(
                value < low, warning("is below training minimum", low)
            )
        )
    listed = new.select("shipment_id", F.inline_outer(F.array(*found)))
    return listed.where(F.col("feature").isNotNull())


# Share of the rows on each side of the middle that a bracket takes in, and how exact the
# percentiles are (their error is one part in so many of the rows).
BRACKET = 5e-5
ACCURACY = 100_000


def exact_medians(df: DataFrame, *columns: str) -> dict[str, float | None]:
    """Exact medians without sorting or collecting a column, in at most three scans.

    A median is the value at one rank, or the mean of two. The first scan brackets the ranks by
    approximate percentiles. The second counts the values below each bracket and, distinct value
    by distinct value, those inside: as a rule that settles it, since a bracket holds about
    ``BRACKET`` of the rows. Where the ranks fall outside after all, a third scan counts the whole
    column. Only the values at the ranks reach the driver.
    """
    values = df.select(*[finite(c).cast("double").alias(c) for c in columns])
    ranks = [0.5 - BRACKET, 0.5 + BRACKET]
    first = values.agg(
        *[F.count(c).alias(f"rows_{c}") for c in columns],
        *[F.percentile_approx(c, ranks, ACCURACY).alias(f"near_{c}") for c in columns],
    ).first()
    brackets = {c: tuple(first[f"near_{c}"]) for c in columns if first[f"rows_{c}"]}
    rows = {c: first[f"rows_{c}"] for c in brackets}
    found = _at_middle(values, brackets, rows)
    missed = {c: (-math.inf, math.inf) for c in brackets if c not in found}
    found |= _at_middle(values, missed, rows) if missed else {}
    return {c: found.get(c) for c in columns}


def _at_middle(
    values: DataFrame, brackets: dict[str, tuple[float, float]], rows: dict[str, int]
) -> dict[str, float]:
    """The medians that lie inside their brackets, from one scan of the values."""
    names = list(brackets)
    if not names:
        return {}

    def placed(index: int, name: str) -> Column:
        low, high = brackets[name]
        value = F.col(name)
        # Values below the bracket are one group.
        inside = F.when(value >= low, value)
        return F.when(
            value <= high, F.struct(F.lit(index).alias("i"), inside.alias("v"))
        )

    listed = values.select(F.inline(F.array(*[placed(i, c) for i, c in enumerate(names)])))
    counts = listed.where(F.col("i").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the distinct values of a bracket.
    order = W.partitionBy("i").orderBy(F.asc_nulls_first("v"))
    upto = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    middle = F.array(
        *[F.array(*[F.lit(r) for r in ((rows[c] - 1) // 2, rows[c] // 2)]) for c in names]
    )
    wanted = upto.select("*", F.explode(F.get(middle, F.col("i"))).alias("rank"))
    hits = wanted.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    pairs: dict[str, list[float]] = {}
    for row in hits.collect():  # two rows a column
        if row["v"] is not None:
            pairs.setdefault(names[row["i"]], []).append(row["v"])
    return {c: pair[0] / 2 + pair[1] / 2 for c, pair in pairs.items() if len(pair) == 2}


def fill_missing(new: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Absent or NULL features take the training median; ``imputed`` names them."""
    marks, filled = [], {}
    for feature, median in medians.items():
        present = F.col(feature).cast("double") if feature in new.columns else F.lit(None).cast("double")
        marks.append(F.when(present.isNull(), F.lit(feature)))
        filled[feature] = F.coalesce(present, F.lit(median))
    imputed = F.filter(F.array(*marks), lambda m: m.isNotNull())
    return new.withColumn("imputed", imputed).withColumns(filled)


# Fixed value: the warning on a filled feature, after its title.
IMPUTED = " is missing. The median of the training data is used."


def imputation_warnings(filled: DataFrame, key: str = "shipment_id") -> DataFrame:
    """A row per filled feature of ``fill_missing``: key, feature, value used, message."""
    listed = filled.select(key, *FEATURE_TITLES, F.explode("imputed").alias("feature"))
    titles = F.create_map(*[F.lit(x) for pair in FEATURE_TITLES.items() for x in pair])
    used = F.create_map(*[x for f in FEATURE_TITLES for x in (F.lit(f), F.col(f))])
    return listed.select(
        key,
        "feature",
        used[F.col("feature")].alias("value"),
        F.concat(titles[F.col("feature")], F.lit(IMPUTED)).alias("message"),
    )
