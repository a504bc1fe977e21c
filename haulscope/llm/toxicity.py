"""Toxicity scores by a factorization machine over hashed terms.

A linear model adds up what single terms say. The machine also gives every term a short vector, and
each pair of terms the product of theirs, so that a word that is harmless alone or only next to
some others is told apart. It is fitted on a bounded sample of the labelled rows, in one task, and
is then a few thousand numbers that travel with the plan; every document is scored where it lies,
without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from haulscope.llm import common
from haulscope.llm.factorization import Machine, Terms, fit

# Labelled rows the machine is fitted on, at most: those with the smallest hash of their doc_id.
SAMPLE_ROWS = 8_000
BITS = 17
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's labels are kept for evaluation; NULL counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: order, toxic, text."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one_each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id").alias("order")
    chosen = one_each.select("doc_id", "toxic", order).orderBy("order", "doc_id").limit(rows)
    # The broadcast side is the sample's ids: ``rows`` of them at most.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> Machine:
    """The machine fitted on the sample. Without usable labels all scores are its bias."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Terms(bits)
        for batch in batches:
            found = [np.sort(number(t)).astype(np.int32) for t in batch["text"]]
            yield batch[["order", "doc_id", "toxic"]].assign(terms=found)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([pd.DataFrame(columns=["order", "doc_id", "toxic", "terms"]), *batches])
        whole = whole.sort_values(["order", "doc_id"])
        arrays = [np.asarray(t, np.int64) for t in whole["terms"]]
        model = fit(arrays, whole["toxic"].to_numpy(float), bits)
        parts = (model.bias, model.terms, model.weights, model.factors)
        yield pd.DataFrame({"model": [pickle.dumps(parts)]})

    key = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"order bigint, doc_id {key}, toxic int, terms array<int>"
    chosen = sample(docs, labels, rows).withColumn("toxic", F.col("toxic").cast("int"))
    model = chosen.mapInPandas(terms, kinds).repartition(1).mapInPandas(fitted, "model binary")
    found = model.first()
    if not found:
        return Machine(-2.2, np.zeros(0, int), np.zeros(0), np.zeros((0, 4)))
    return Machine(*pickle.loads(bytes(found[0])))


def score(docs: DataFrame, model: Machine, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """All documents with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Only the text is looked at. A NULL or empty text gets the score of a text without known terms.
    Other columns pass through; those with the names of results are replaced; equal texts get equal
    scores, so repeated rows do; a NULL doc_id is held out or not like an empty one; an empty table gives
    no rows.
    """
    docs = common.spare(docs, "held_out", "score", "predicted")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Terms(bits, frozenset(model.terms.tolist()))
        for batch in batches:
            found = [model.score(number(t)) for t in batch.column("text").to_pylist()]
            arrays = [*batch.columns, pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    found = docs.mapInArrow(scored, schema)
    return found.select(*docs.columns, held_out().alias("held_out"), "score", predicted)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels and scores all documents."""
    return score(docs, train(docs, labels))


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity(docs, common.read(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
