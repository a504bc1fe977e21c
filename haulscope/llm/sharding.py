"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: it starts at one slot
and steps on by a stride, both from a hash of its name. The shards take turns, each claiming its
first slot that is still free, until the table is full. So all shards hold the same number of
slots but for one, and a table made for a changed list of shards differs in few slots. A row is
placed by the slot its key hashes to: one look-up in a broadcast table of fixed size, with no
shuffle, whatever the size or the skew of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm import common

SHARDS = tuple(f"shard-{n:03d}" for n in range(32))
# A prime, a hundred slots for each shard: the largest and smallest shard differ by 1 %.
TABLE_SIZE = 3_209
# The look-up table is broadcast; its size is this parameter, never the data's.
LARGEST_TABLE = 1_000_003


def fill_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position of its shard in ``shards``.

    ``size`` is a prime above the number of shards and at most ``LARGEST_TABLE``. Shards with the
    same name, or none, are an error.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not len(shards) <= size <= LARGEST_TABLE or not _is_prime(size):
        raise ValueError(f"the table size must be a prime from {len(shards)} to {LARGEST_TABLE}")
    at, stride = [], []
    for name in shards:
        bits = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(bits[:8], "big") % size)
        stride.append(1 + int.from_bytes(bits[8:], "big") % max(1, size - 1))
    table, free = [-1] * size, size
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % size
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: str | Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text. NULL counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(size)


def table_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """The look-up table: slot, shard number, shard name."""
    numbers = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slots = spark.range(0, size, 1, 1).select(
        F.col("id").alias("slot"), F.get(numbers, F.col("id").cast("int")).cast("int").alias("n")
    )
    return slots.select("slot", F.col("n").alias("shard_no"), F.get(names, F.col("n")).alias("shard"))


def place(
    rows: DataFrame,
    key: str = "doc_id",
    shards: Sequence[str] = SHARDS,
    size: int = TABLE_SIZE,
) -> DataFrame:
    """All rows with ``slot``, ``shard_no`` and ``shard``.

    Equal keys share a shard, so repeated rows stay together; NULL keys are placed like the empty
    text. The input's own columns of these names are replaced; an empty input gives no rows.
    """
    table = table_frame(rows.sparkSession, shards, size)
    kept = common.spare(rows, "slot", "shard_no", "shard")
    return (
        kept.withColumn("slot", slot_of(key, size))
        .join(F.broadcast(table), "slot")
        .select(*kept.columns, "slot", "shard_no", "shard")
    )


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return place(docs).select("doc_id", "slot", "shard_no", "shard")


def oracle() -> str:
    table = ", ".join(map(str, fill_table()))
    return f"""
        WITH slots AS (
            SELECT doc_id,
                   ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT
                       % {TABLE_SIZE} AS slot
            FROM documents
        ), numbered AS (
            SELECT doc_id, slot, ([{table}])[slot + 1]::INTEGER AS shard_no FROM slots
        )
        SELECT doc_id, slot, shard_no, 'shard-' || lpad(CAST(shard_no AS VARCHAR), 3, '0') AS shard
        FROM numbered
    """
