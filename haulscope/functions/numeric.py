"""Money, ratios and rounding.

Money is summed in whole cents as a long: exact, independent of the order in which partial
sums arrive (so a re-run task cannot change a total), and cheaper than a wide decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: ColumnLike) -> Column:
    """NaN and infinities become NULL (Spark orders NaN above every number)."""
    value = as_col(value)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def cents(value: ColumnLike) -> Column:
    return F.rint(as_col(value) * 100).cast("long")


def dollars(value: ColumnLike) -> Column:
    return as_col(value).cast("double") / F.lit(100.0)


def half_even(value: ColumnLike, digits: int) -> Column:
    """Round half to even on the scaled double; ``bround`` goes through BigDecimal per row."""
    if digits == 0:
        return F.rint(as_col(value))
    scale = F.lit(float(10**digits))
    return F.rint(as_col(value) * scale) / scale


def ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    """``part / whole``; NULL where the whole is 0 or unknown."""
    return F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))


def percent(part: ColumnLike, whole: ColumnLike, digits: int = 1) -> Column:
    return half_even(ratio(part, whole) * 100, digits)


def zero_if_null(value: ColumnLike) -> Column:
    return F.coalesce(as_col(value), F.lit(0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def thousands(value: ColumnLike) -> Column:
    """``#,##0`` text; an unknown value reads ``nan``, an infinite one ``inf``."""
    value = as_col(value).cast("double")
    infinite = F.abs(value) == F.lit(float("inf"))
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("nan"))
        .when(infinite, F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(F.format_number(F.when(~infinite, value), 0))
    )


def plain(value: ColumnLike) -> Column:
    """Whole-number text without separators."""
    value = as_col(value).cast("double")
    return F.coalesce(F.rint(value).try_cast("bigint").cast("string"), value.cast("string"))


# Fixed value: the number syntax an upload may use.
NUMBER_PATTERN = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"


def parse_number(text: ColumnLike) -> Column:
    """Double of a number text, else NULL. Suffixes (``12d``) and ``1_000`` are no numbers."""
    trimmed = F.trim(as_col(text))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
