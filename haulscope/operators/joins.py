"""Joins of a large table to a side that is expected, but not known, to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haulscope.session import settle

# A side is broadcast up to this many bytes: what its texts, arrays, maps and structs hold, plus a flat
# amount per row.
BROADCAST_BYTES = 64 * 1024 * 1024
BYTES_PER_ROW = 64


def size_of(df: DataFrame) -> int:
    """Bytes of a (settled) result: its texts, its nested values as JSON (never fewer bytes than
    their texts, a handful for each number), and a flat amount per row. Runs a job."""
    per_row = F.lit(BYTES_PER_ROW).cast("bigint")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            per_row = per_row + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            per_row = per_row + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0))).first()[0]


def join_measured(
    large: DataFrame, side: DataFrame, on: str | Column | list[str], how: str, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join to ``side``, which is computed once, measured, and broadcast if it is small enough.

    Adaptive execution alone would learn the size too late: the large table is shuffled at the
    same time as the side. Beyond the limit it is a plain join, whose skewed partitions adaptive
    execution splits. Runs two small jobs.
    """
    settled = settle(side)
    if size_of(settled) <= limit:
        settled = F.broadcast(settled)
    return large.join(settled, on, how)


def ids_in_use(side: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """``side`` cut to the keys that ``large`` uses: its distinct keys, combined inside tasks."""
    return side.join(large.select(key).distinct(), key, "left_semi")
