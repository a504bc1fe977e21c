"""Order over a whole table without one task that sees it: ranges of keys, counts, prefix sums.

A table is range-partitioned by its keys, sorted inside the ranges and stored with the number of its
range (``part``, also the folder) and of the row in it (``nth``). Counts of the ranges add up to where
each one starts, so the place of any row is known, and any place is found by opening one range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haulscope.session import settle, written

# Bits of Spark's row ids that count rows inside a task.
_ROW_BITS = 33


def by_range(df: DataFrame, *keys: str | Column, purpose: str = "ranges") -> DataFrame:
    """``df`` sorted by ``keys`` over the whole table, stored, with ``part`` and ``nth`` (eager).

    Equal keys share a range: pre-aggregate, or add a further key, where one key may be hot.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    numbered = spread.withColumns(
        {
            "part": F.shiftright(place, _ROW_BITS).cast("int"),
            "nth": place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    return written(numbered, purpose, "part")


def starts(stored: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per range its rows (or the sum of ``weight``) and those of the ranges before (part, held, before): a row a
    range, settled."""
    held = stored.groupBy("part").agg(F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("held"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(earlier), F.lit(0)).cast("bigint")
    return settle(held.select("part", "held", before.alias("before")))


def positions(history: DataFrame, cost: str, asked: DataFrame, estimate: str) -> DataFrame:
    """Every row of ``asked`` with ``below`` (rows of ``history`` that cost no more than its estimate) and
    ``history`` (rows with a known cost). Unknown estimates have an unknown ``below``.

    Costs and estimates are counted by value first, so a frequent one is a single row; the values
    of both are merged in order inside ranges, and only these meet the rows of ``asked``.
    """
    costs = history.where(F.col(cost).isNotNull()).groupBy(F.col(cost).alias("value"))
    costs = costs.agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.where(F.col(estimate).isNotNull()).select(F.col(estimate).alias("value"))
    wanted = wanted.distinct().select("value", F.lit(0).cast("bigint").alias("n"))
    merged = costs.unionByName(wanted).groupBy("value").agg(F.sum("n").alias("n"))
    stored = by_range(merged, "value", purpose="cost-ranges")
    ranges = starts(stored, F.col("n"))
    upto = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = stored.withColumn("upto", F.sum("n").over(upto))
    # One row a range: as many as the shuffle has partitions.
    placed = running.join(F.broadcast(ranges), "part")
    placed = placed.select("value", (F.col("upto") + F.col("before")).alias("below"))
    total = ranges.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("history")).scalar()
    joined = asked.join(placed, F.col(estimate) == F.col("value"), "left").drop("value")
    return joined.withColumn("history", total)


@dataclass(frozen=True)
class PageIndex:
    """A table in key order, cut into pages of ``size`` rows; ``ranges`` has (part, held, before)."""

    stored: DataFrame
    ranges: list[tuple[int, int, int]]
    size: int

    @property
    def rows(self) -> int:
        return sum(held for _, held, _ in self.ranges)

    @property
    def pages(self) -> int:
        return -(-self.rows // self.size)

    def page(self, number: int) -> DataFrame:
        """Page ``number`` (from 1) in key order, with ``place`` (from 1), ``first_row``, ``last_row`` and
        ``total_rows``; empty past the end. Only the ranges that hold the page are read."""
        if number < 1:
            raise ValueError("pages are numbered from 1")
        first, stop = (number - 1) * self.size, min(number * self.size, self.rows)
        met = [r for r in self.ranges if r[2] < stop and r[2] + r[1] > first]
        before = F.lit(0)
        for part, _, skipped in met:
            before = F.when(F.col("part") == part, F.lit(skipped)).otherwise(before)
        # The bounds inside each range are stated too, so that blocks of rows are skipped.
        inside = F.lit(False)
        for part, _, skipped in met:
            here = F.col("nth").between(first - skipped, stop - skipped - 1)
            inside = inside | ((F.col("part") == part) & here)
        rows = self.stored.where(F.col("part").isin([r[0] for r in met]) & inside)
        return (
            rows.withColumn("place", (before + F.col("nth") + 1).cast("bigint"))
            .drop("part", "nth")
            .withColumns(
                {
                    "first_row": F.lit(first + 1).cast("bigint"),
                    "last_row": F.lit(stop).cast("bigint"),
                    "total_rows": F.lit(self.rows).cast("bigint"),
                }
            )
            .orderBy("place")
        )


def page_index(df: DataFrame, *keys: str | Column, size: int = 25) -> PageIndex:
    """Store ``df`` in key order and count its ranges (eager). Built once, it serves every page at the
    price of one range; the driver holds one row a range."""
    if size < 1:
        raise ValueError("a page has a row at least")
    stored = by_range(df, *keys, purpose="page-index")
    return PageIndex(stored, [tuple(r) for r in starts(stored).orderBy("part").collect()], size)
