"""The forest grown over cells is the one that Spark's own trainer grows."""

import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from haulscope.operators import cost_model, forest, growth


def sparks_forest(rows, fitted):
    """Spark's trainer over the same rows in the same order, with the same settings."""
    known = cost_model.training_rows(rows)
    known = known.repartition(cost_model.TRAIN_PARTITIONS, cost_model.KEY).sortWithinPartitions(*known.columns).cache()
    regressor = cost_model.RandomForestRegressor(
        featuresCol="features", labelCol=cost_model.TARGET, predictionCol="estimate", featureSubsetStrategy="all",
        numTrees=fitted.forest.getNumTrees, maxDepth=fitted.forest.getMaxDepth(), maxBins=fitted.forest.getMaxBins(),
        seed=fitted.forest.getSeed(),
    )
    features = known
    for stage in fitted.pipeline.stages[:-1]:
        features = stage.transform(features)
    return Pipeline(stages=[regressor]).fit(features).stages[-1]


def nodes_of(spark, model, values, folder):
    model.write().overwrite().save(str(folder))
    return forest.flatten(spark, str(folder), values)


def shipments(spark, n, *, distinct, costs):
    """Costs that depend on everything a little; few distinct values bring many equally good splits."""
    i = F.col("id")
    return spark.range(n).select(
        F.format_string("S%06d", "id").alias("shipment_id"),
        F.when(i % 11 != 3, F.format_string("Carrier %02d", F.pmod(F.xxhash64("id"), F.lit(6)))).alias("carrier"),
        F.when(i % 3 == 0, "Dock").when(i % 3 == 1, "Yard").alias("facility"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(distinct)).cast("double").alias("weight_lbs"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(distinct)) - distinct // 3).cast("double").alias("miles"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(costs)) / 100 + i % 6 * 7.1).alias("total_cost_usd"),
    )


@pytest.mark.parametrize(
    ("n", "distinct", "costs", "trees", "depth", "bins"),
    [(12_000, 5_000, 90_000, 3, 8, 64), (700, 12, 4, 6, 7, 32), (150, 1_000, 50_000, 5, 5, 64), (120, 1, 1, 3, 4, 16), (400, 40, 90_000, 2, 0, 64)],
)
def test_the_forest_is_that_of_sparks_trainer(spark, tmp_path, n, distinct, costs, trees, depth, bins):
    rows = shipments(spark, n, distinct=distinct, costs=costs)
    fitted = cost_model.fit(rows, trees=trees, max_depth=depth, max_bins=bins)
    theirs = sparks_forest(rows, fitted)
    values = [len(seen) for seen in fitted.indexer.labelsArray]
    expected = nodes_of(spark, theirs, values, tmp_path / "theirs")
    for name, column in fitted.nodes.items():
        if name == "value":
            assert column == pytest.approx(expected[name], rel=1e-12)
        else:
            assert (column == expected[name]).all(), name
    ours = fitted.forest.featureImportances.toArray()
    assert ours == pytest.approx(theirs.featureImportances.toArray(), rel=1e-9, abs=1e-12)
    assert [t.numNodes for t in fitted.forest.trees] == [t.numNodes for t in theirs.trees]


def test_a_level_is_a_pass_over_the_rows(spark, monkeypatch):
    """However many trees and nodes there are: a pass, and one more only where rounding may have decided."""
    passes = []
    looked = growth._looked
    monkeypatch.setattr(growth, "_looked", lambda *a, **k: passes.append(len(a[2])) or looked(*a, **k))
    cost_model.fit(shipments(spark, 3_000, distinct=900, costs=90_000), trees=40, max_depth=4)
    assert len(passes) <= 8
    assert passes[0] == 40


def test_passes_leave_no_shuffle_files(spark, monkeypatch):
    """They would pile up, level by level."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    looked, left = growth._looked, []

    def files():
        return disk.getAllFiles().mkString(" ").count("/shuffle_")

    def watched(*args, **more):
        args[0].count()  # kept from here on
        before, found = files(), looked(*args, **more)
        until = time.time() + 20
        while files() > before and time.time() < until:
            time.sleep(0.1)
        left.append(files() - before)
        return found

    monkeypatch.setattr(growth, "_looked", watched)
    cost_model.fit(shipments(spark, 2_000, distinct=900, costs=90_000), trees=5, max_depth=4)
    assert max(left) <= 0


def test_rows_come_down_a_tree_of_any_depth():
    """Look-ups by words and steps below them, against one condition after another."""
    rng = np.random.default_rng(5)
    depth, sizes, n = 9, [7, 40, 30], 40_000
    count = 2 ** (depth + 1) - 1
    at = np.arange(count)
    inner = (at < 2**depth - 1) & (rng.random(count) < 0.95)
    starts = np.cumsum(sizes) - sizes
    source = rng.integers(0, 3, count)
    low = starts[source] + rng.integers(0, 6, count) - (source == 0)
    nodes = {
        "source": source, "low": low.astype(float), "high": np.where(source == 0, low + 1.0, np.inf),
        "left": np.where(inner, 2 * at + 1, at), "right": np.where(inner, 2 * at + 2, at),
        "roots": np.array([0]), "depth": np.array(depth),
    }
    cells = np.stack([begin + rng.integers(0, size, n) for begin, size in zip(starts, sizes)])
    found = forest.arrived(nodes, forest.signposts(nodes, sizes, 0), cells)
    expected = np.zeros(n, int)
    for _ in range(depth):
        x = cells[source[expected], np.arange(n)]
        right = (x > nodes["low"][expected]) & (x <= nodes["high"][expected])
        expected = np.where(right, nodes["right"][expected], nodes["left"][expected])
    assert (found == expected).all()


def test_numbers_that_are_none_go_left_as_before():
    nodes = {
        "source": np.array([0, 0, 0], np.int16), "low": np.array([1.5, 0, 0]), "high": np.array([np.inf, 0, 0]),
        "left": np.array([1, 1, 2]), "right": np.array([2, 1, 2]), "value": np.array([0.0, 10.0, 20.0]),
        "roots": np.array([0]), "depth": np.array(1),
    }
    found = forest.Walk(nodes, 1).trees(np.array([[1.5, 1.6, np.nan, np.inf, -np.inf]]))
    assert found[:, 0].tolist() == [10.0, 20.0, 10.0, 20.0, 10.0]


def test_numbers_that_are_not_finite_are_refused(spark):
    rows = shipments(spark, 300, distinct=50, costs=900).withColumn(
        "miles", F.when(F.col("shipment_id") == "S000007", F.lit(float("nan"))).otherwise(F.col("miles"))
    )
    with pytest.raises(Exception, match="NaN"):
        cost_model.fit(rows, trees=2, max_depth=2)
