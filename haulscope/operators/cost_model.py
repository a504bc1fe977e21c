"""Random-forest estimate of the total cost, with an interval from the single trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from haulscope.functions.numeric import half_even
from haulscope.functions.text import feature_label
from haulscope.operators import forest, growth, guards
from haulscope.session import cleaned, work_folder

KEY = "shipment_id"
CATEGORIES = ("carrier", "facility")
NUMBERS = ("weight_lbs", "miles")
TARGET = "total_cost_usd"

# Forest size, seed, and the normal quantile of the 95 % interval.
TREES = 200
SEED = 42
QUANTILE = 1.96

# Training rows are dealt out by shipment id to so many partitions, whatever they were read from:
# bootstrap samples are drawn per partition, so the forest must not depend on files or cores.
TRAIN_PARTITIONS = 16
# Up to this many values of a category, each is a feature; beyond, values are hashed into buckets,
# which are the features: values of one bucket are not told apart.
MAX_CATEGORIES = 10_000
BUCKETS = 1_024
# Sums of the nodes that one pass over the rows fills, in MB for each task: a level of trees that needs more
# takes several passes, of a tree each at least. Trees, splits and estimates do not depend on it.
GROUP_MB = 128
# Leaves that all trees together may have.
MAX_LEAVES = 4_000_000


@dataclass(frozen=True)
class CostModel:
    """A fitted pipeline, its forest as node arrays, and the medians of the numeric features over the
    training rows."""

    pipeline: PipelineModel
    nodes: forest.Nodes
    medians: dict[str, float]

    @property
    def forest(self):
        return self.pipeline.stages[-1]

    @property
    def indexer(self):
        return next(s for s in self.pipeline.stages if isinstance(s, StringIndexerModel))


def training_rows(view: DataFrame) -> DataFrame:
    """The model's columns of the rows that have all of them but, perhaps, a category."""
    known = [F.col(c).isNotNull() for c in (*NUMBERS, TARGET)]
    condition = known[0]
    for one in known[1:]:
        condition = condition & one
    return view.where(condition).select(KEY, *CATEGORIES, *NUMBERS, TARGET)


def fit(
    view: DataFrame,
    *,
    trees: int = TREES,
    max_depth: int = 8,
    max_bins: int = 64,
    seed: int = SEED,
    least_rows: int = guards.LEAST_ROWS,
) -> CostModel:
    """Train (eager). Spark bins split candidates and caps the depth, so the forest resembles
    one grown to the last sample but does not equal it. Rows are dealt out by shipment id and
    sorted, so that the same rows give the same forest however they were read. That is done once and
    kept on the executors' disks until the forest is there: every step of the fit reads the rows again."""
    if trees * 2**max_depth > MAX_LEAVES:
        raise ValueError(f"trees x 2^max_depth is limited to {MAX_LEAVES:,} leaves")
    known = training_rows(view)
    rows = known.repartition(TRAIN_PARTITIONS, KEY).sortWithinPartitions(*known.columns)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        _least(rows, least_rows)
        features = _features(rows)
        regressor = RandomForestRegressor(
            featuresCol="features",
            labelCol=TARGET,
            predictionCol="estimate",
            numTrees=trees,
            maxDepth=max_depth,
            maxBins=max_bins,
            seed=seed,
            featureSubsetStrategy="all",
            subsamplingRate=1.0,
            maxMemoryInMB=GROUP_MB,
        )
        indexer = next(s for s in features.stages if isinstance(s, StringIndexerModel))
        values = [len(seen) for seen in indexer.labelsArray]
        inputs = _inputs(features.stages, rows).select(*(f"{c}_index" for c in CATEGORIES), *NUMBERS, TARGET)
        grown = growth.grow(inputs, regressor, values)
        medians = guards.exact_medians(rows, *NUMBERS)
    finally:
        rows.unpersist()
    folder = cleaned(view.sparkSession, work_folder(view.sparkSession, "cost-model"))
    trained = growth.stored(view.sparkSession, grown, regressor, sum(values) + len(NUMBERS), folder)
    nodes = forest.flatten(view.sparkSession, folder, values)
    return CostModel(PipelineModel([*features.stages, trained]), nodes, medians)


def _least(rows: DataFrame, least_rows: int) -> None:
    seen = rows.limit(least_rows).count()
    if seen < least_rows:
        raise ValueError(f"Minimum {least_rows} historical records required. Current: {seen}.")


def _features(rows: DataFrame) -> PipelineModel:
    """The stages that make the features of a row: a one for each value of a category, and the numbers."""
    kinds = rows.agg(*[F.count_distinct(c).alias(c) for c in CATEGORIES]).first()
    hashed = [c for c in CATEGORIES if kinds[c] > MAX_CATEGORIES]
    labels = [f"{c}_bucket" if c in hashed else c for c in CATEGORIES]
    indexed = [f"{c}_index" for c in CATEGORIES]
    hot = [f"{c}_hot" for c in CATEGORIES]
    # 'keep' gives unseen categories the last index, which the encoder drops: a zero vector.
    stages = [
        *([_buckets(hashed)] if hashed else []),
        StringIndexer(inputCols=labels, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=[*hot, *NUMBERS], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(rows)


def _inputs(stages: list, rows: DataFrame) -> DataFrame:
    """With the index of each category, without the features that are made of it."""
    for stage in stages:
        rows = stage.transform(rows)
        if isinstance(stage, StringIndexerModel):
            break
    return rows


def _buckets(hashed: list[str]) -> SQLTransformer:
    """A pipeline stage that adds the bucket of each category that has too many values."""
    parts = [
        f"CASE WHEN {c} IS NOT NULL THEN concat('bucket ', lpad(CAST(pmod(xxhash64({c}), {BUCKETS}) AS STRING), 4, '0')) END AS {c}_bucket"
        for c in hashed
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def predict(model: CostModel, rows: DataFrame, *, each_tree: bool = True) -> DataFrame:
    """Add ``imputed``, ``tree_estimates`` (unless not wanted), ``estimate``, ``lower``, ``upper`` and ``spread`` to every row.

    A missing weight or distance takes the training median; ``imputed`` names those features.
    Categories are indexed in the JVM; all trees are then evaluated at once over Arrow batches,
    where the rows lie. Mean and population deviation of the trees give the interval.
    """
    inputs = _inputs(model.pipeline.stages, guards.fill_missing(rows, model.medians))
    columns = [*(f"{c}_index" for c in CATEGORIES), *NUMBERS]
    kept = list(dict.fromkeys([*rows.columns, *NUMBERS, "imputed"]))
    found = forest.evaluate(inputs, model.nodes, columns, kept, QUANTILE, each_tree)
    return found.select(
        *rows.columns,
        "imputed",
        *(["tree_estimates"] if each_tree else []),
        "estimate",
        F.greatest(F.lit(0.0), F.col("estimate") - F.col("margin")).alias("lower"),
        (F.col("estimate") + F.col("margin")).alias("upper"),
    ).withColumn("spread", F.col("upper") - F.col("lower"))


def compare(predicted: DataFrame, baselines: DataFrame) -> DataFrame:
    """Set each estimate against cost per mile times miles and against the fleet mean."""
    fleet = baselines.select(F.struct("avg_cpm", "avg_total").alias("fleet")).scalar()
    bound = predicted.withColumn("_fleet", fleet)
    return bound.withColumns(
        {
            "simple_estimate": F.col("_fleet.avg_cpm") * F.col("miles"),
            "fleet_average": F.col("_fleet.avg_total"),
        }
    ).drop("_fleet").withColumns(
        {
            "delta_simple": F.col("estimate") - F.col("simple_estimate"),
            "delta_fleet": F.col("estimate") - F.col("fleet_average"),
        }
    )


def feature_importance(model: CostModel, rows: int | None = None) -> DataFrame:
    """Importance per named feature, largest first (one row per feature of the model). Features are the
    values of a category, or its buckets where it has been hashed, and the numbers."""
    spark = SparkSession.active()
    values = model.forest.featureImportances.toArray().tolist()
    labels = model.indexer.labelsArray
    names = [f"{c}_{label}" for c, seen in zip(CATEGORIES, labels) for label in seen]
    pairs = list(zip([*names, *NUMBERS], values, strict=True))
    table = spark.createDataFrame(pairs, "feature string, importance double")
    ranked = table.orderBy(F.desc("importance"), "feature")
    if rows is not None:
        ranked = ranked.limit(rows)
    return ranked.select(
        feature_label("feature").alias("feature"), half_even("importance", 6).alias("importance")
    )
