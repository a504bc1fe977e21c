"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed in k-grams of five words; of the k-grams of each window
of ten words, only the one with the smallest hash is kept. Ten words that a document shares with a
benchmark item have the same k-grams and so the same smallest one: every shared window meets in the
join of these fingerprints, with a fraction of the rows that all k-grams would make. A hit is then
extended: at the places of the met k-grams, the ten-word windows around them are compared in full.

Items shorter than ten words are one window each; they are met by the hash of the whole window.
Texts are worked on once per distinct text, so that copies of a document cost one row. Only
fingerprints that occur in the benchmark leave the first pass with their text's hash, so a key
that many documents share is a single row on the benchmark's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm import common
from haulscope.operators.joins import join_measured

WINDOW = 10
K = 5
KEYS = ("_k1", "_k2")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    """Words in lower case of all alphabets, one form of sigma: coarser than A-Z alone.

    Cheap to make; texts with equal words in the exact sense have equal words here too.
    """
    lower = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def exact_words(text: Column) -> Column:
    """Words after lower-casing A-Z only."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def grams(words: str, n: int) -> Column:
    """Hashes of all runs of ``n`` words of a column."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    at = lambda i, k: F.get(F.col(words), i + k)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(n)]))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


def winnowed(hashes: str) -> Column:
    """The smallest hash of each window of ten words, in the order of the windows."""
    per_window = WINDOW - K + 1
    starts = F.when(F.size(hashes) >= per_window, F.sequence(F.lit(0), F.size(hashes) - per_window))
    at = lambda i, k: F.get(F.col(hashes), i + k)
    least = F.transform(starts, lambda i: F.least(*[at(i, k) for k in range(per_window)]))
    return F.coalesce(least, F.array().cast("array<bigint>"))


def window_runs(df: DataFrame) -> DataFrame:
    """Adds ``runs``: neighbouring windows with one fingerprint (f), from window i, so many (len)."""
    df = df.withColumn("m", winnowed("g"))
    at = lambda i: F.get(F.col("m"), i)
    changes = F.filter(
        F.transform("m", lambda h, i: F.when((i == 0) | (h != at(i - 1)), i)), lambda x: x.isNotNull()
    )
    df = df.withColumn("c", changes)
    until = lambda j: F.coalesce(F.get(F.col("c"), j + 1), F.size("m"))
    run = lambda x, j: F.struct(
        at(x).alias("f"), x.alias("i"), (until(j) - x).alias("len"), F.lit(WINDOW).alias("n")
    )
    return df.withColumn("runs", F.transform("c", run))


def whole_runs(words: str, n: int) -> Column:
    """All windows of ``n`` words, for items of that many words, in the form of ``runs``."""
    run = lambda f, i: F.struct(
        f.alias("f"), i.alias("i"), F.lit(1).alias("len"), F.lit(n).alias("n")
    )
    return F.transform(grams(words, n), run)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items: item_id, window (words joined by a space), n (its words)."""
    items = benchmark.select("item_id", exact_words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0)
    last = F.greatest(F.size("w") - WINDOW, F.lit(0))
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return starts.select(
        "item_id", "n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("window")
    ).distinct()


def item_fingerprints(benchmark: DataFrame, short: list[int]) -> DataFrame:
    """The distinct fingerprints of all items: winnowed k-grams, and whole short items."""
    items = benchmark.select(folded_words(F.col("text")).alias("w"))
    items = items.withColumn("g", grams("w", K))
    whole = [F.when(F.size("w") == n, grams("w", n)) for n in short]
    none = F.array().cast("array<bigint>")
    all_of = F.concat(winnowed("g"), *[F.coalesce(x, none) for x in whole])
    return items.select(F.explode(all_of).alias("f")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents with ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and hit runs.

    A word is hit when it lies in an occurrence of a window of ten consecutive item words (all
    words of an item with fewer). ``hit_runs`` are the maximal runs of hit words (first, length).
    A NULL or empty text on either side has no words; an item whose id is NULL is left out of
    ``items`` but its hits count. Repeated rows and items are judged alike; columns pass through,
    those with the names of results are replaced.
    """
    results = ("n_words", "n_hit", "items", "hit_runs")
    docs = common.spare(docs, *results, *KEYS)
    windows = item_windows(benchmark)
    # One row for each length below ten, nine at most.
    short = sorted(r.n for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect())
    keyed = docs.withColumns(dict(zip(KEYS, common.digest("text"), strict=True)))

    # First pass: fingerprints of every text, met with those of the benchmark.
    texts = keyed.select(*KEYS, folded_words(F.col("text")).alias("w"))
    texts = window_runs(texts.withColumn("g", grams("w", K)))
    wholes = [whole_runs("w", n) for n in short]
    emitted = texts.select(*KEYS, F.explode(F.concat("runs", *wholes)).alias("r"))
    emitted = emitted.select(*KEYS, "r.*")
    met = join_measured(emitted, item_fingerprints(benchmark, short), "f", "inner")
    met = met.groupBy(*KEYS).agg(F.collect_set(F.struct("i", "len", "n")).alias("met"))

    # Second pass: the texts that met, each fetched from its row with the least doc_id and compared
    # in full where they met. Other copies of a text stay where they are.
    least = keyed.groupBy(*KEYS).agg(F.min("doc_id").alias("_doc"))
    wanted = met.join(least, list(KEYS)).withColumnsRenamed({"_k1": "_m1", "_k2": "_m2"})
    same = (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2"))
    # The few texts that met are narrow rows: while they fit a broadcast, no text is shuffled.
    texts = keyed.select(*KEYS, "doc_id", "text")
    held = join_measured(texts, wanted, same & F.col("doc_id").eqNullSafe(F.col("_doc")), "inner")
    hits = extended(held.select(*KEYS, "text", "met"), windows)

    counted = keyed.withColumn("n_words", F.size(words_of_any_case("text")).cast("bigint"))
    joined = counted.join(hits, list(KEYS), "left")
    no_runs = F.array().cast("array<struct<first:int,length:int>>")
    return joined.select(
        *docs.columns,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit_runs", no_runs).alias("hit_runs"),
    )


def words_of_any_case(text: str) -> Column:
    """The words as they stand: as many as after lower-casing."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def extended(held: DataFrame, windows: DataFrame) -> DataFrame:
    """Per text the hit words and the items, from windows that are equal word for word."""
    held = held.withColumn("w", exact_words(F.col("text")))
    # The words are named twice, so that Spark keeps them as a column and doesn't cut the text
    # again for each window.
    window = lambda i, n: F.struct(
        i.alias("i"),
        n.alias("n"),
        F.array_join(F.slice("w", i + 1, F.least(n, F.size("w"))), " ").alias("window"),
    )
    each = lambda r: F.transform(
        F.sequence(r["i"], r["i"] + r["len"] - 1), lambda i: window(i, r["n"])
    )
    tried = held.select(*KEYS, F.explode(F.flatten(F.transform("met", each))).alias("t"))
    tried = tried.select(*KEYS, "t.*")
    by_window = windows.groupBy("window", "n").agg(F.collect_set("item_id").alias("ids"))
    found = join_measured(tried, by_window, ["window", "n"], "inner")
    per_text = found.groupBy(*KEYS).agg(
        F.collect_set(F.struct("i", "n")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"),
    )
    every = F.transform("spans", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))
    hit = per_text.withColumn("p", F.sort_array(F.array_distinct(F.flatten(every))))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get(F.col("p"), i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get(F.col("p"), i + 1) != x + 1, F.lit(True)))
    hit = hit.withColumns({"s": starts, "e": ends})
    run = lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length"))
    names = F.sort_array(F.transform("ids", lambda x: x.cast("string")))
    return hit.select(
        *KEYS,
        F.size("p").cast("bigint").alias("n_hit"),
        names.alias("items"),
        F.zip_with("s", "e", run).alias("hit_runs"),
    )


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, common.read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents),
        b AS (
            SELECT item_id, {words} AS w, least(len(w), {WINDOW}) AS n FROM benchmark WHERE len(w) > 0
        ), item_windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS window
            FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)
        ), doc_windows AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS window
            FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
        ), met AS (
            SELECT doc_id, x.n, i, item_id FROM doc_windows x
            JOIN item_windows y ON x.window = y.window AND x.n = y.n
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met
                  WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """
