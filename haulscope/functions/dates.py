"""Dates and weeks, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from haulscope.functions.numeric import ColumnLike, as_col

# The accepted date formats, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy",
)


def parse_date(text: ColumnLike, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    trimmed = F.trim(as_col(text))
    tries = [F.try_to_timestamp(trimmed, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def week_start(moment: ColumnLike) -> Column:
    """Monday 00:00 of the ISO week. ``trunc`` works on dates, so no time zone is involved."""
    return F.trunc(as_col(moment).cast("date"), "week").cast("timestamp_ntz")


def us_date(moment: ColumnLike) -> Column:
    return F.date_format(as_col(moment), "MM/dd/yyyy")
