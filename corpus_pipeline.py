"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents with
benchmark text go, sources are mixed to their weights, and what is left is put into shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Stages see all rows that the stage before has kept. Rows with NULLs, empty texts or no
doc_id are treated as the operators' docstrings say; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm import common, decontamination, mixing, sharding, simhash_dedup, toxicity

# No SQL for the rows of ``run``: a machine is trained, and the mix draws at random.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the machine, fitted on the labels of ``docs``, does not call toxic."""
    scored = toxicity.toxicity(docs, common.read(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row: one with the smallest doc_id."""
    found = simhash_dedup.near_duplicates(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A row for each group by now, unless rows repeat a doc_id.
    return first.dropDuplicates(["component_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window of ten words with a benchmark item."""
    found = decontamination.contamination(docs, common.read(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and each time it is taken."""
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with slot, shard_no and shard."""
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
