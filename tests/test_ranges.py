"""Places in order: positions of estimates, page index."""

import random
import re
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from haulscope.operators import joins, ranges
from haulscope.plans import costs, shipments


@pytest.mark.parametrize("partitions", ["3", "8"])
def test_positions_equal_bisection(spark, partitions):
    rng = random.Random(3)
    past = [rng.choice([None, 7.5, 7.5, 7.5, round(rng.uniform(0, 40), 1)]) for _ in range(900)]
    asked = [None, -1.0, 0.0, 7.5, 7.49, 99.0, *(round(rng.uniform(0, 40), 2) for _ in range(200)), 7.5]
    history = spark.createDataFrame([(v,) for v in past], "cost double").repartition(5)
    rows = spark.createDataFrame(list(enumerate(asked)), "k int, guess double").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = ranges.positions(history, "cost", rows, "guess").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known = sorted(v for v in past if v is not None)
    assert len(found) == len(asked) and {r.history for r in found} == {len(known)}
    for r in found:
        assert r.guess == asked[r.k]
        assert r.below == (None if r.guess is None else bisect_right(known, r.guess))


def test_positions_without_history_or_estimates(spark):
    none = spark.createDataFrame([], "cost double")
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "k int, guess double")
    assert [(r.below, r.history) for r in ranges.positions(none, "cost", rows, "guess").orderBy("k").collect()] == [(0, 0), (None, 0)]
    past = spark.createDataFrame([(1.0,)], "cost double")
    assert ranges.positions(past, "cost", rows.limit(0), "guess").count() == 0


def test_no_all_pairs_in_positions(spark, tables):
    plan = costs.freight_positions(tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_predicted_costs_have_positions(tables):
    fitted = costs.fit(tables, trees=3, max_depth=3)
    placed = costs.estimate_positions(tables, costs.estimates(tables, fitted)).select("estimate", "below", "history", "percentile")
    rows = placed.collect()
    past = sorted(r[0] for r in shipments.named_shipments(tables).select("total_cost_usd").collect() if r[0] is not None)
    assert all(r.below == bisect_right(past, r.estimate) and r.history == len(past) for r in rows)


@pytest.mark.parametrize("size", [1, 7, 25, 1000])
def test_pages_are_the_sorted_table_cut(spark, size):
    keys = [f"K{i % 83:03d}" for i in range(300)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int").repartition(6)
    index = ranges.page_index(df, "key", "n", size=size)
    assert (index.rows, index.pages) == (300, -(-300 // size))
    everything = sorted((k, i) for i, k in enumerate(keys))
    for number in {1, min(2, index.pages), index.pages // 2 or 1, index.pages}:
        rows = index.page(number).collect()
        first = (number - 1) * size
        assert [(r.key, r.n) for r in rows] == everything[first : first + size]
        assert [r.place for r in rows] == list(range(first + 1, first + 1 + len(rows)))
        assert {(r.first_row, r.last_row, r.total_rows) for r in rows} == {(first + 1, first + len(rows), 300)}
    assert index.page(index.pages + 1).count() == 0
    with pytest.raises(ValueError):
        index.page(0)


def test_a_deep_page_opens_one_range(spark, tables):
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # a small table would be one range
    spark.conf.set(merging, "false")
    try:
        index = shipments.page_index(tables)
    finally:
        spark.conf.unset(merging)
    assert len(index.ranges) > 4
    page = index.page(index.pages // 2)
    assert page.count() == 25
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    # The folder of one range, and in it a stretch of rows.
    assert re.search(r"\(part#\d+ = \d+\)", plan) and re.search(r"\(nth#\d+L >= \d+\)", plan)


def test_an_empty_table_has_no_pages(spark):
    index = ranges.page_index(spark.createDataFrame([], "key string"), "key")
    assert (index.rows, index.pages) == (0, 0) and index.page(1).count() == 0


def test_sizes_count_arrays(spark):
    ids = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("item-"), i))
    wide = spark.range(3).select("id", ids.alias("ids"))
    assert joins.size_of(wide) > 3 * 1_000_000
    assert joins.size_of(spark.range(3)) == 3 * joins.BYTES_PER_ROW
    assert joins.size_of(spark.range(0).select(ids.alias("ids"))) == 0
