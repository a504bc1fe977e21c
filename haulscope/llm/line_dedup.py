"""Exact removal of lines that repeat across documents, reported as bitmaps.

Every line becomes a row of hash, document and position; the text stays where it is. The rows
are partitioned by ranges of the hash and sorted by hash, document and position, so that one pass
over a partition meets each line's first document first and marks the line in all later ones. The
marks of a document become a run-length coded bitmap of the lines to keep.

A line that a large share of the documents holds would fill one range. Such keys are found on a
sample (which decides about balance only, never about a result), and split by salts: within a
salt all but its first document are settled, and the firsts of the salts meet in a second, small
pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from haulscope.llm import common

MIN_CHARS = 10
# Share of the documents looked at to balance partitions.
SAMPLE = 0.02
# A key is split when it holds more than this share of a partition; no more keys than four a
# partition can do so, which bounds the broadcast list.
SPLIT_SHARE = 0.25


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return common.ascii_lower(F.btrim(line, F.lit(common.BLANKS)))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line whose key is long enough: document, text digest, position, hashes."""
    exploded = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(common.lines("text"))
    ).select("doc_id", "text_key", F.col("pos"), line_key(F.col("col")).alias("key"))
    long_enough = exploded.where(F.char_length("key") >= min_chars)
    return long_enough.select("doc_id", "text_key", "pos", *common.digest("key", "h"))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines to drop: doc_id, text_key, pos. First documents (smallest doc_id) are left out."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = F.broadcast(_salts(docs.sample(SAMPLE, seed=11), min_chars, parts))
    rows = line_rows(docs, min_chars).join(salts, ["h1", "h2"], "left")
    spread = F.pmod(F.xxhash64("doc_id", "text_key"), F.col("salts"))
    rows = rows.withColumn("salt", F.coalesce(spread, F.lit(-1)).cast("int")).drop("salts")
    # Partitioning by range looks at its input twice: at narrow rows, not at the texts again.
    rows = common.written(rows, "line-hashes")
    by_key = Window.partitionBy("h1", "h2", "salt").orderBy(F.asc_nulls_last("doc_id"), "pos")
    first = F.first("doc_id").over(by_key)
    seen = (
        rows.repartitionByRange(parts, "h1", "h2", "salt")
        .withColumn("later", ~F.col("doc_id").eqNullSafe(first))
        .where(F.col("later") | (F.col("salt") >= 0))
    )
    # What is settled already is spread over the partitions of the second pass.
    group = F.when(F.col("later"), F.xxhash64("doc_id", "pos"))
    firsts = Window.partitionBy("h1", "h2", "group").orderBy(F.asc_nulls_last("doc_id"), "pos")
    settled = seen.withColumn("group", group).withColumn("first", F.first("doc_id").over(firsts))
    drop = F.col("later") | ~F.col("doc_id").eqNullSafe(F.col("first"))
    return settled.where(drop).select("doc_id", "text_key", "pos")


def _salts(sample: DataFrame, min_chars: int, parts: int) -> DataFrame:
    """Keys that would overfill a partition, and into how many salts each is split."""
    counts = line_rows(sample, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1.0, total * SPLIT_SHARE / parts)
    # A key seen a few times in the sample may be chance; one this rare fits a partition anyway.
    heavy = counts.where((F.col("n") > share) & (F.col("n") >= 20))
    return heavy.select("h1", "h2", F.ceil(F.col("n") / share).alias("salts"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One bitmap for each document that loses lines: doc_id, text_key, keep_bitmap.

    The bitmap is run-length coded: numbers of lines kept, dropped, kept ... in turn; after the
    last number all lines are kept.
    """
    found = repeated_lines(docs, min_chars).groupBy("doc_id", "text_key")
    dropped = found.agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get(F.col("p"), i + 1) != x + 1, F.lit(True)))
    runs = dropped.select("doc_id", "text_key", starts.alias("s"), ends.alias("e"))
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(F.col("e"), i - 1))
    pairs = F.transform(
        "s", lambda x, i: F.array(x - before(i) - 1, F.get(F.col("e"), i) - x + 1)
    )
    return runs.select("doc_id", "text_key", F.flatten(pairs).alias("keep_bitmap"))


def keep_flags(bitmap: Column) -> Column:
    """A bitmap as an array of booleans, up to the last dropped line."""
    return F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat((i % 2) == 0, n)))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents with ``n_lines``, ``n_dropped``, ``keep_bitmap`` and ``kept_text``.

    A line's key is the stripped line with A-Z lower-cased. Keys of ``min_chars`` code points or
    more that two documents hold lose their lines in all documents but the one with the smallest
    doc_id, which keeps all of its own. A NULL or empty text is one empty line. Rows with the same
    doc_id are one document; rows without one are together one document, after all others. Further
    columns pass through; own columns with the names of results are replaced.
    """
    results = ("n_lines", "n_dropped", "keep_bitmap", "kept_text")
    docs = common.spare(docs, *results, "text_key")
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_chars)
    maps = maps.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(maps["_doc"]) & (keyed["text_key"] == maps["_key"])
    joined = keyed.join(maps, same, "left").drop("text_key", "_doc", "_key")
    split = joined.withColumns(
        {"lines": common.lines("text"), "flags": keep_flags(F.col("keep_bitmap"))}
    )
    kept = F.filter("lines", lambda x, i: F.coalesce(F.get(F.col("flags"), i), F.lit(True)))
    n_dropped = F.coalesce(
        F.size(F.filter("flags", lambda keep: ~keep)), F.lit(0)
    )
    text = F.when(F.col("flags").isNull(), F.coalesce("text", F.lit("")))
    return split.select(
        *docs.columns,
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("flags").isNull(), 0).otherwise(n_dropped).cast("bigint").alias("n_dropped"),
        "keep_bitmap",
        text.otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    return dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def oracle() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH cut AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS key
            FROM cut
        ), repeated AS (
            SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {MIN_CHARS}
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), judged AS (
            SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.first_doc AS gone
            FROM keyed k LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines,
               count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
                   AS kept_sha256
        FROM judged GROUP BY doc_id
    """
