"""Rule-based risk score of an upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haulscope.functions import risk
from haulscope.functions.numeric import finite, parse_number

NUMERIC = ("weight_lbs", "miles", "base_freight_usd")
NOISE_SPAN = 0.2


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Texts to doubles; what is no number becomes 0."""
    return df.withColumns(
        {name: F.coalesce(finite(parse_number(F.col(name).cast("string"))), F.lit(0.0)) for name in NUMERIC}
    )


def score(df: DataFrame, noise: str = "none") -> DataFrame:
    """Add ``risk_score`` and ``risk_tier``.

    ``noise='hash'`` adds up to 0.2 derived from the id: unlike a draw by row position it is the
    same whatever the partitioning, and on every attempt of a task.
    """
    jitter = None
    if noise == "hash":
        jitter = F.pmod(F.xxhash64("shipment_id"), F.lit(1_000_000)) / F.lit(1e6) * NOISE_SPAN
    elif noise != "none":
        raise ValueError(f"unknown noise {noise!r}")
    ready = coerce_numbers(df)
    scored = ready.withColumn("risk_score", risk.rule_score("weight_lbs", "miles", jitter))
    return scored.withColumn("risk_tier", risk.tier("risk_score"))
