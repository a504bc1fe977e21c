"""Exact token totals for every context limit from a histogram of lengths.

Documents are encoded with a public vocabulary and counted by length. The histogram has one row a
length and is all that is needed: sums over the lengths from a limit on tell how many documents
reach it, how many tokens they have, and what is left when every document is cut there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from haulscope.llm import common
from haulscope.session import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts were cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A vocabulary is sent along with the tasks; larger files are refused.
MAX_BYTES = 64 << 20
# Texts are encoded in pieces of about so many characters, cut where the pattern cuts anyway.
PIECE = 1 << 16
# Lengths of one bucket; suffix sums go over buckets first.
BUCKET = 1_024


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    return data


def token_lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """All documents with ``n_tokens``, but for their texts: special tokens are ordinary text, NULL and
    empty texts have none. Repeated rows count each; a column named ``n_tokens`` is replaced, others pass
    through; an empty table gives no rows."""
    docs = common.spare(docs, "n_tokens")
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(vocabulary(path))
    pattern, piece = PATTERN, PIECE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pairs = (line.split() for line in data.value.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            found = [
                sum(len(encoding.encode_ordinary(part)) for part in parts(text or "", piece))
                for text in batch.column("text").to_pylist()
            ]
            names = [n for n in batch.schema.names if n != "text"]
            arrays = [*(batch.column(n) for n in names), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint"])
    return docs.mapInArrow(count, schema)


def parts(text: str, size: int) -> Iterator[str]:
    """A text in pieces of ``size`` characters or a little more.

    Pieces end before a single space between two letters: no match of the pattern goes across.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (
            text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()
        ):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Length and number of documents; one row a length, summed up inside tasks first."""
    return lengths.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram with what follows for a context limit of each length.

    ``docs_from`` and ``tokens_from``: documents of this length or more, and their tokens.
    ``tokens_within``: tokens when all documents are cut at this length. ``share_upto``: the share
    of documents of this length or less (the length is the quantile of all shares up to it and
    above the one before). Sums go over buckets of lengths and then inside each bucket.

    The histogram is computed once, however often it is read here: one row a length, so small. An empty
    histogram gives no rows; repeated lengths must have been added up; further columns are left out.
    """
    counts = settle(counts.select("length", "docs"))
    rows = counts.withColumns(
        {"tokens": F.col("length") * F.col("docs"), "bucket": F.floor(F.col("length") / BUCKET)}
    )
    sums = rows.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("bigint")
    beyond = sums.select(
        "bucket",
        F.coalesce(F.sum("d").over(later), none).alias("d"),
        F.coalesce(F.sum("t").over(later), none).alias("t"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    onward = Window.partitionBy("bucket").orderBy(F.desc("length"))
    onward = onward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(beyond, "bucket")
    docs_from = F.sum("docs").over(onward) + F.col("d")
    tokens_from = F.sum("tokens").over(onward) + F.col("t")
    found = joined.withColumns({"docs_from": docs_from, "tokens_from": tokens_from})
    return found.select(
        "length",
        "docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias(
            "tokens_within"
        ),
        F.round((F.col("all_docs") - F.col("docs_from") + F.col("docs")) / F.col("all_docs"), 9).alias(
            "share_upto"
        ),
    )


def within(sums: DataFrame, limit: int) -> int:
    """Tokens when all documents are cut at ``limit``, exact for every limit: one row is read."""
    least = sums.where(F.col("length") >= limit).orderBy("length").select(
        "docs_from", "tokens_from", "tokens_within", "length"
    ).first()
    if least:
        # Between two lengths, the documents at or above the limit give one token less each.
        return least.tokens_within - least.docs_from * (least.length - limit)
    top = sums.orderBy(F.desc("length")).select("tokens_within").first()
    return top[0] if top else 0


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed."""
    found = sums.where(F.col("share_upto") >= share - 1e-9).agg(F.min("length")).first()
    return found[0]


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("text")
    return suffix_sums(histogram(token_lengths(docs)))
