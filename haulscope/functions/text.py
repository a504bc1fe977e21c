"""Labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from haulscope.functions.numeric import ColumnLike, as_col

# Lane separator, stand-in for an unknown end, ellipsis, "nothing to show".
LANE_ARROW = " → "
UNKNOWN_END = "?"
ELLIPSIS = "…"
DASH = "—"


def lane(origin: ColumnLike, destination: ColumnLike) -> Column:
    unknown = F.lit(UNKNOWN_END)
    return F.concat(
        F.coalesce(as_col(origin), unknown),
        F.lit(LANE_ARROW),
        F.coalesce(as_col(destination), unknown),
    )


def shorten(label: ColumnLike, limit: int, keep: int | None = None) -> Column:
    """Whole label up to ``limit`` characters, else its first ``keep`` (limit-3) and an ellipsis."""
    label = as_col(label)
    kept = limit - 3 if keep is None else keep
    return F.when(F.length(label) <= limit, label).otherwise(
        F.concat(F.substring(label, 1, kept), F.lit(ELLIPSIS))
    )


def is_blank(text: ColumnLike) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(F.trim(as_col(text).cast("string"), F.lit(" \t\r\n")), F.lit("")) == ""


def is_missing(text: ColumnLike) -> Column:
    """NULL or empty: white space is a value, if not a good one."""
    return F.coalesce(as_col(text).cast("string"), F.lit("")) == ""


# How model inputs are shown.
FEATURE_LABELS = (
    ("carrier_", "Carrier: "),
    ("facility_", "Facility: "),
    ("weight_lbs", "Weight (lbs)"),
    ("miles", "Miles"),
)


def feature_label(name: ColumnLike) -> Column:
    label = as_col(name)
    for raw, shown in FEATURE_LABELS:
        label = F.replace(label, F.lit(raw), F.lit(shown))
    return label
