"""Mixing sources to target weights by blocks.

The words of each source are packed into blocks of fixed length, documents one after another. The
output is a row of shards with a fixed number of slots, a slot holding one block. How many slots of
a shard go to each source is a multinomial draw with the target weights; the draws are then settled
so that every source's total is the number of blocks nearest to its target. A source's slots are
numbered through all shards, and slot j takes the block at place j of a pseudorandom permutation of
the source's blocks; each pass over the blocks has its own. So no block is taken more than once
more than another, a reader of any shard range knows its blocks without a list, and a re-run makes
the same mix. Blocks and slots are joined by index: a source with a third of all rows is spread
over all partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from haulscope.llm import common

BLOCK_WORDS = 32
SHARD_SLOTS = 65_536
MAX_TIMES = 3
SEED = 20_240_601
# Documents of a source are put in line by chunks, so that no window holds a whole source.
CHUNK_DOCS = 4_000
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the number of words of the text (0 for NULL)."""
    return docs.withColumn("size", F.size(common.words("text")).cast("bigint"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_TIMES) -> DataFrame:
    """Per source: source_size, weight and target (words).

    Sources in order of code points, NULL last, get the weights in turn. The targets share out all
    words by weight; a target stops at ``most`` times its source's size, and what is above is
    shared out again among the others. That ends at targets of min(most * size, level * weight):
    sources are filled up in order of size per weight, and the level is what remains for the rest.
    The windows are over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    weighed = by_source.withColumn("weight", weight)
    cap = most * F.col("source_size")
    filled = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / F.sum("weight").over(onward)
    levelled = weighed.withColumns({"level": level, "full": cap <= level * F.col("weight")})
    # All sources before the first that isn't full are at their cap; the others share its level,
    # which is the highest of theirs.
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full"), cap.cast("double")).otherwise(shared * F.col("weight")).alias("target"),
    )


def plan(goals: DataFrame, block_words: int = BLOCK_WORDS, most: int = MAX_TIMES) -> DataFrame:
    """Adds to the targets a number for each source, its blocks and its slots in the mix."""
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    # Blocks are all full but for the last, so slots are counted in the source's mean block.
    slots = F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("bigint")
    numbered = goals.withColumns({"source_no": number.cast("int"), "blocks": blocks})
    slots = F.when(F.col("source_size") > 0, F.least(slots, most * F.col("blocks"))).otherwise(0)
    return numbered.withColumn("slots", slots.cast("bigint"))


def draws(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Per shard and source: its slots (n), and the number of the first of them in the source.

    Each shard draws on its own. The sums are then settled: what a source has drawn too much or
    too little is taken from or given to the shards evenly.
    """
    spark = planned.sparkSession
    shares = planned.where(F.col("slots") > 0).select("source_no", "slots")
    total = shares.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, part in batch.groupby("shard", sort=True):
                part = part.sort_values("source_no")
                size = min(shard_slots, total - int(shard) * shard_slots)
                share = part["slots"].to_numpy(float)
                n = np.random.default_rng([seed, int(shard)]).multinomial(size, share / share.sum())
                yield part[["shard", "source_no", "slots"]].assign(n=n)

    # One row a shard and source: a few rows per 65,536 slots, each shard's rows together.
    rows = spark.range(shards).withColumnRenamed("id", "shard")
    rows = rows.crossJoin(_listed(shares))  # a single row
    rows = rows.select("shard", F.explode("all").alias("s")).select("shard", "s.*")
    schema = "shard bigint, source_no int, slots bigint, n bigint"
    drawn = common.written(rows.mapInPandas(draw, schema), "draws")
    sums = drawn.groupBy("source_no").agg(F.sum("n").alias("sum"))
    drawn = drawn.join(sums, "source_no")
    lead = F.col("slots") - F.col("sum")
    order = Window.partitionBy("source_no").orderBy("shard")
    ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The running sums are scaled to the exact total, so that all numbers stay whole and positive.
    upto = F.floor(
        F.sum("n").over(ahead).cast("decimal(38,0)") * F.col("slots") / F.col("sum")
    ).cast("bigint")
    ends = drawn.where(F.col("sum") > 0).withColumns({"end": upto, "lead": lead})
    start = F.lag("end", 1, 0).over(order)
    missed = drawn.where((F.col("sum") == 0) & (F.col("shard") == 0)).select(
        "shard", "source_no", F.col("slots").alias("n"), F.lit(0).cast("bigint").alias("first")
    )
    settled = ends.select(
        "shard", "source_no", (F.col("end") - start).alias("n"), start.alias("first")
    )
    return settled.unionByName(missed)


def _listed(shares: DataFrame) -> DataFrame:
    """The sources' numbers and slots as one row; as many entries as there are sources."""
    return shares.agg(F.collect_list(F.struct("source_no", "slots")).alias("all"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of 0..n-1 in a pseudorandom permutation, each on its own (Feistel, cycle walking)."""
    bits = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    rounds = np.random.default_rng(key).integers(0, 2**63, 4).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        high, low = x >> np.uint64(bits), x & mask
        for k in rounds:
            z = (low + k) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            high, low = low, high ^ ((z >> np.uint64(29)) & mask)
        return (high << np.uint64(bits)) | low

    found = once(index.astype(np.uint64))
    while (beyond := found >= n).any():
        found[beyond] = once(found[beyond])
    return found.astype(np.int64)


def slots(planned: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: one row a slot with shard, source_no, time (which pass over the blocks), block."""
    counts = planned.select("source_no", "blocks")
    rows = drawn.where(F.col("n") > 0).join(counts, "source_no")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                j = np.arange(r.first, r.first + r.n)
                time, index = j // r.blocks, j % r.blocks
                block = np.empty(len(j), np.int64)
                for t in np.unique(time):
                    at = time == t
                    key = [seed, int(r.source_no), int(t)]
                    block[at] = permuted(index[at], int(r.blocks), key)
                yield pd.DataFrame(
                    {"shard": r.shard, "source_no": r.source_no, "time": time, "block": block}
                )

    schema = "shard bigint, source_no int, time bigint, block bigint"
    return rows.repartition("shard", "source_no").mapInPandas(place, schema)


def pieces(sized: DataFrame, planned: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents (row_key) cut at block borders: source_no, block, first word, words.

    ``sized`` has row_key, source, size. Documents follow one another by row_key within chunks.
    """
    n = sized.count()
    chunks = max(1, -(-n // CHUNK_DOCS))
    numbered = sized.where(F.col("size") > 0).join(
        planned.select(F.col("source").alias("_s"), "source_no"),
        F.col("source").eqNullSafe(F.col("_s")),
    )
    chunked = numbered.withColumn("chunk", F.pmod(F.xxhash64("row_key"), F.lit(chunks)))
    sums = chunked.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    # As many rows a source as it has chunks.
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "source_no", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source_no", "chunk").orderBy("row_key")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lined = chunked.withColumn("ahead", ahead).join(offsets, ["source_no", "chunk"])
    lined = lined.withColumn("from", F.col("base") + F.col("ahead"))
    lined = lined.withColumn("upto", F.col("from") + F.col("size"))
    first, last = F.col("from"), F.col("upto") - 1
    blocks = F.sequence(
        F.floor(first / block_words).cast("bigint"), F.floor(last / block_words).cast("bigint")
    )
    cut = lined.select("row_key", "source_no", "from", "upto", F.explode(blocks).alias("block"))
    start = F.greatest(F.col("block") * block_words, F.col("from"))
    end = F.least((F.col("block") + 1) * block_words, F.col("upto"))
    return cut.select(
        "row_key",
        "source_no",
        "block",
        (start - F.col("from")).alias("first"),
        (end - start).alias("words"),
    )


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with row_key, size, source_size and target; and what the mix takes of each.

    The second has row_key, time (pass over the source's blocks), first (word), words: one row for
    each piece of a document and each time it is taken. Equal rows are documents of their own.
    A NULL or empty text has no words and is never taken; a NULL source is a source of its own, after
    all others. Columns named as results are replaced, others pass through in the first table. An
    empty table gives two empty ones.
    """
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text", "source", "doc_id")))
    sized = sizes(common.spare(docs, "size", "source_size", "target", "row_key")).withColumn("row_key", key)
    copy = F.row_number().over(Window.partitionBy("row_key").orderBy("size"))
    sized = sized.withColumn("row_key", F.concat_ws("#", "row_key", copy.cast("string")))
    narrow = common.written(sized.select("row_key", "source", "size"), "sizes")
    planned = common.written(plan(targets(narrow), block_words), "mix-plan")
    taken = slots(planned, draws(planned, seed=seed), seed)
    cut = pieces(narrow, planned, block_words)
    # Spark takes the slots, made by Python from a few draws, for a few rows: they are as many as
    # there are blocks, so they are never broadcast.
    times = taken.select("source_no", "block", "time").hint("merge")
    found = cut.hint("merge").join(times, ["source_no", "block"])
    goals = planned.select(F.col("source").alias("_s"), "source_size", "target")
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined, found.select("row_key", "time", "first", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each document and time it is taken.

    The text of a row is what one pass over the source's blocks takes of the document: the whole
    text, or the taken words joined by spaces. ``n_chars``, where there is one, is counted anew; a column
    named ``size``, ``source_size`` or ``target`` holds those of the mix, others are kept. NULL and empty
    texts are not in the mix; equal rows are taken each for itself; an empty table gives no rows.
    """
    sized, taken = mixed(docs, block_words, seed)
    parts = taken.groupBy("row_key", "time").agg(
        F.sum("words").alias("_words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_parts")
    )
    joined = sized.join(parts, "row_key").withColumn("_all", common.words("text"))
    cut = F.flatten(
        F.transform(
            "_parts",
            lambda p: F.slice("_all", (p["first"] + 1).cast("int"), p["words"].cast("int")),
        )
    )
    # The words are named twice, so that Spark keeps them as a column and doesn't cut the text
    # again for each piece.
    whole = F.col("_words") == F.size("_all")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(cut, " "))
    rebuilt = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rebuilt = rebuilt.withColumn("n_chars", F.char_length("text").cast(kind))
    return rebuilt.select(*docs.columns)


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text", "source")
    sized, taken = mixed(docs)
    words = taken.groupBy("row_key").agg(F.sum("words").alias("taken"))
    joined = sized.join(words, "row_key", "left")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
