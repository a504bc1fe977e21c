"""Cost model by its properties, guards by hand-made rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from haulscope.operators import cost_model, guards
from haulscope.plans import costs, shipments


@pytest.fixture(scope="module")
def model(tables):
    return costs.fit(tables, trees=20, max_depth=5)


@pytest.fixture(scope="module")
def estimates(tables, model):
    return costs.estimates(tables, model).cache()


def test_every_shipment_is_estimated_and_filled_ones_are_marked(estimates, tables):
    named = shipments.named_shipments(tables)
    assert estimates.count() == named.count()
    missing = named.where("miles IS NULL OR weight_lbs IS NULL").count()
    assert estimates.where("size(imputed) > 0").count() == missing > 0
    assert estimates.where("miles IS NULL OR weight_lbs IS NULL OR estimate IS NULL").count() == 0


def test_how_rows_were_read_does_not_matter(tables):
    view = shipments.named_shipments(tables)
    found = []
    for partitions in (2, 7):
        fitted = cost_model.fit(view.repartition(partitions), trees=5, max_depth=3)
        rows = cost_model.predict(fitted, view).select("shipment_id", "estimate").collect()
        found.append({r.shipment_id: r.estimate for r in rows})
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-9) for k in found[0])


def test_training_rows_are_read_once(spark, tables):
    """Sorting, counting, indexing, splitting, training and the medians share one reading of the rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    view = shipments.named_shipments(tables).select(
        cost_model.KEY, *cost_model.CATEGORIES, *cost_model.NUMBERS, cost_model.TARGET
    )
    cost_model.fit(view.mapInArrow(counted, view.schema), trees=2, max_depth=3)
    assert read.value == view.count()


def test_the_forest_does_not_depend_on_how_many_nodes_a_pass_fills(tables, monkeypatch):
    view = shipments.named_shipments(tables)
    found = []
    for size in (cost_model.GROUP_MB, 0, 256):
        monkeypatch.setattr(cost_model, "GROUP_MB", size)
        fitted = cost_model.fit(view, trees=5, max_depth=4)
        assert fitted.forest.getMaxMemoryInMB() == size
        found.append(fitted.nodes)
    for other in found[1:]:
        assert all((found[0][name] == other[name]).all() for name in other if name != "value")
        assert other["value"] == pytest.approx(found[0]["value"], rel=1e-12)


def test_too_many_leaves_are_refused(tables):
    view = shipments.named_shipments(tables)
    with pytest.raises(ValueError, match="leaves"):
        cost_model.fit(view, trees=200, max_depth=25)


def test_categories_up_to_the_limit_are_features_and_beyond_it_buckets(tables, monkeypatch):
    view = shipments.named_shipments(tables)
    carriers = view.where("carrier IS NOT NULL").select("carrier").distinct().count()
    for limit, bucketed in ((carriers, False), (carriers - 1, True)):
        monkeypatch.setattr(cost_model, "MAX_CATEGORIES", limit)
        fitted = cost_model.fit(view, trees=2, max_depth=3)
        labels = fitted.indexer.labelsArray[0]
        assert all(label.startswith("bucket ") for label in labels) is bucketed
        assert len(labels) == carriers or bucketed
        listed = [r.feature for r in cost_model.feature_importance(fitted).collect()]
        assert any(f.startswith("Carrier: bucket ") for f in listed) is bucketed
        forest_estimates(fitted, view)


def forest_estimates(fitted, view):
    """The array walk and Spark's own forest say the same of every row."""
    inputs = guards.fill_missing(
        view.select("shipment_id", *cost_model.CATEGORIES, *cost_model.NUMBERS), fitted.medians
    )
    theirs = fitted.pipeline.transform(inputs).select("shipment_id", F.col("estimate").alias("forest"))
    ours = cost_model.predict(fitted, inputs.drop("imputed"))
    gap = ours.join(theirs, "shipment_id").agg(F.max(F.abs(F.col("estimate") - F.col("forest")))).first()[0]
    assert gap is not None and gap < 1e-9


def test_fifty_thousand_carriers(spark):
    n = 60_000
    named = spark.range(n).withColumn("carrier", F.format_string("Carrier %05d", F.col("id") % 50_000))
    # The carriers of one bucket cost more.
    dear = F.pmod(F.xxhash64("carrier"), F.lit(cost_model.BUCKETS)) == 5
    rows = named.select(
        F.format_string("S%06d", "id").alias("shipment_id"),
        "carrier",
        F.when(F.col("id") % 2 == 0, "Dock").otherwise("Yard").alias("facility"),
        (F.col("id") % 977 + 1.0).alias("weight_lbs"),
        F.when(F.col("id") % 50 != 7, F.col("id") % 313 + 1.0).alias("miles"),
        (F.when(dear, 50_000.0).otherwise(0.0) + F.col("id") % 313).alias("total_cost_usd"),
    )
    fitted = cost_model.fit(rows, trees=3, max_depth=4, max_bins=16)
    assert len(fitted.indexer.labelsArray[0]) == cost_model.BUCKETS
    forest_estimates(fitted, rows)
    assert cost_model.predict(fitted, rows).where("estimate IS NOT NULL").count() == n
    top = cost_model.feature_importance(fitted, 2).collect()
    assert "Carrier: bucket 0005" in {r.feature for r in top}


def test_mean_of_trees_is_the_forest(estimates, model, tables):
    inputs = shipments.named_shipments(tables).select(
        "shipment_id", *cost_model.CATEGORIES, *cost_model.NUMBERS
    )
    inputs = guards.fill_missing(inputs, model.medians)
    forest = model.pipeline.transform(inputs).select("shipment_id", F.col("estimate").alias("forest"))
    gap = estimates.join(forest, "shipment_id").agg(F.max(F.abs(F.col("estimate") - F.col("forest"))))
    assert gap.first()[0] < 1e-9


def test_single_trees_agree(estimates, model, tables):
    """The looked-up leaf values are what each tree predicts by itself."""
    row = estimates.where("size(imputed) = 0").orderBy("shipment_id").first()
    one = shipments.named_shipments(tables).where(F.col("shipment_id") == row.shipment_id)
    features = one.select(*cost_model.CATEGORIES, *cost_model.NUMBERS)
    for stage in model.pipeline.stages[:-1]:
        features = stage.transform(features)
    vector = features.select("features").first()[0]
    assert row.tree_estimates == [tree.predict(vector) for tree in model.forest.trees]


def test_interval(estimates):
    for row in estimates.orderBy("shipment_id").limit(20).collect():
        deviation = statistics.pstdev(row.tree_estimates)
        assert row.lower == pytest.approx(max(0.0, row.estimate - 1.96 * deviation))
        assert row.upper == pytest.approx(row.estimate + 1.96 * deviation)
    assert estimates.where("lower < 0 OR lower > estimate OR upper < estimate").count() == 0


def test_comparison(estimates, tables):
    fleet = costs.fleet_baselines(tables).first()
    row = estimates.first()
    assert row.simple_estimate == pytest.approx(fleet.avg_cpm * row.miles)
    assert row.delta_fleet == pytest.approx(row.estimate - fleet.avg_total)


def test_unseen_categories_still_predict(spark, model):
    new = spark.createDataFrame(
        [("N1", "Nobody", "Nowhere", 9000.0, 400.0), ("N2", None, None, 9000.0, 400.0)],
        "shipment_id string, carrier string, facility string, weight_lbs double, miles double",
    )
    found = cost_model.predict(model, new).collect()
    assert len(found) == 2 and found[0].estimate == found[1].estimate > 0


def test_importance(model):
    found = cost_model.feature_importance(model).collect()
    assert sum(r.importance for r in found) == pytest.approx(1, abs=1e-4)
    assert {"Miles", "Weight (lbs)"} == {r.feature for r in found[:2]}
    assert any(r.feature.startswith("Carrier: Supplier#") for r in found)
    assert cost_model.feature_importance(model, 3).count() == 3


def test_too_few_rows(tables):
    view = shipments.named_shipments(tables).limit(75)
    with pytest.raises(ValueError, match="Minimum 100 historical records required. Current: 7"):
        cost_model.fit(view)


# --- guards ---------------------------------------------------------------------------------


def facts(spark, *groups):
    """Groups of (rows, flag, carrier)."""
    parts = [
        spark.range(n).select(F.lit(flag).cast("int").alias("flag"), F.lit(who).alias("carrier_id"))
        for n, flag, who in groups
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.union(part)
    return guards.training_guards(guards.training_facts(df, "flag"))


def triggered(df):
    return {r.rule: r.message for r in df.where("triggered").collect()}


def test_healthy_data(spark):
    assert triggered(facts(spark, (60, 1, "a"), (60, 0, "b"))) == {}


def test_few_rows(spark):
    found = facts(spark, (25, 1, "a"), (25, 0, "b"))
    assert triggered(found) == {"too_few_rows": "Minimum 100 historical records required. Current: 50."}
    with pytest.raises(ValueError, match="Current: 50"):
        guards.refuse_if_blocked(found)


def test_one_outcome(spark):
    found = facts(spark, (100, 1, "a"), (100, 1, "b"))
    assert list(triggered(found)) == ["one_outcome"]
    with pytest.raises(ValueError, match="same outcome"):
        guards.refuse_if_blocked(found)


def test_imbalance_is_a_warning(spark):
    found = facts(spark, (490, 0, "a"), (490, 0, "b"), (20, 1, "b"))
    assert "detected (98/2)" in triggered(found)["class_imbalance"]
    guards.refuse_if_blocked(found)


def test_dominance(spark):
    found = facts(spark, (500, 0, "Carrier A"), (450, 1, "Carrier A"), (50, 1, "b"))
    assert triggered(found)["carrier_dominance"].startswith("Training data dominated by Carrier A (95%).")


def test_no_rows_at_all(spark):
    assert set(triggered(facts(spark, (0, 1, "a")))) == {"too_few_rows", "one_outcome"}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] + [(None,)], "flag int")
    found = {r.flag: r.weight for r in guards.class_weights(df, "flag").collect()}
    assert found == {1: 0.666667, 0: 2.0}


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [7.0] * 9, [1.0] * 50 + [2.0] * 50,
        [0.1 * i for i in range(1001)], [1e-9, 1e9, 2e9, -1e9], [float(i * i) for i in range(500)],
        [-1.7e308, 0.0, 1.7e308], [1.7e308, 1.6e308], [-1.7e308, 1.7e308], [5e-324, 0.0, 1e-300],
    ],
)
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    expected = statistics.median([v / 4 for v in values]) * 4
    assert guards.exact_medians(df, "x") == {"x": pytest.approx(expected, rel=1e-15, abs=0)}


def test_medians_are_right_when_the_brackets_miss(spark, monkeypatch):
    monkeypatch.setattr(guards, "BRACKET", -0.4)
    df = spark.createDataFrame([(float(i % 7), float(i)) for i in range(100)], "x double, y double")
    assert guards.exact_medians(df, "x", "y") == {"x": 3.0, "y": 49.5}


def test_imputation_warnings(spark):
    df = spark.createDataFrame([("a", None, 3.0), ("b", 1.0, 2.0)], "shipment_id string, miles double, weight_lbs double")
    found = guards.imputation_warnings(guards.fill_missing(df, {"miles": 5.0, "weight_lbs": 7.0})).collect()
    assert [tuple(r) for r in found] == [
        ("a", "miles", 5.0, "Distance is missing. The median of the training data is used.")
    ]


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert guards.exact_medians(df, "x", "y") == {"x": None, "y": 1.0}


def test_missing_features(spark):
    df = spark.createDataFrame([(1, None), (2, 9.0)], "k int, miles double")
    found = guards.fill_missing(df, {"miles": 5.0, "weight_lbs": 7.0}).orderBy("k").collect()
    assert [(r.miles, r.weight_lbs, r.imputed) for r in found] == [
        (5.0, 7.0, ["miles", "weight_lbs"]), (9.0, 7.0, ["weight_lbs"])
    ]


def test_range_warnings(spark):
    training = spark.createDataFrame([(50.0,), (4200.0,)], "miles double")
    new = spark.createDataFrame(
        [("a", 6500.0), ("b", 50.0), ("c", 10.0), ("d", None)], "shipment_id string, miles double"
    )
    found = guards.range_warnings(new, guards.feature_ranges(training, "miles"), "miles").collect()
    assert {r.shipment_id: r.message for r in found} == {
        "a": "Distance 6500 exceeds training maximum of 4200. Prediction reliability reduced.",
        "c": "Distance 10 is below training minimum of 50. Prediction reliability reduced.",
    }
