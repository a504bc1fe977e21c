"""Line-first cleaning: rules judge each line, the document is judged by what is left.

A line fails when it looks like navigation (words between separators; a menu with one entry a line
has none and passes), when its punctuation is off (words that end in stray symbols), when it names boilerplate, or
when it is one word said over and over. Failing lines are removed; a document that loses too large
a share of its words, or fails the base rules, is rejected. All rules are column expressions over
the one row: no shuffle, no Python, and a long document costs time in proportion to its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.llm import common

SYMBOLS = r"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on a document."""

    # Navigation: this many separators between words, or lines that are mostly separators.
    separators: int = 3
    # Punctuation: the largest share of words that end in a stray symbol.
    symbol_words: float = 0.25
    # One word said over and over: fewer distinct words than this share, in lines of ten or more.
    distinct_words: float = 0.2
    # Boilerplate phrases, compared without case.
    phrases: tuple[str, ...] = (
        "all rights reserved",
        "cookie policy",
        "accept cookies",
        "privacy policy",
        "terms of use",
        "terms of service",
        "enable javascript",
        "subscribe to our newsletter",
        "sign in",
        "log in",
        "read more",
        "click here",
        "lorem ipsum",
    )
    # A boilerplate phrase condemns lines of up to so many words; in longer ones it is a mention.
    boilerplate_words: int = 25
    # A document is rejected when it loses more than this share of its words.
    lost_share: float = 0.5
    # Base rules.
    min_words: int = 10
    repeat_percent: int = 20


RULES = LineRules()


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds the base counts.

    Windows of five words are compared by hash. Only texts with a repeated window sort theirs;
    positions that follow one another by less than five share words, so that each position adds
    the distance to the next, five at most.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({"_words": common.words("text"), "_lines": common.lines("text")})
    word = lambda i, k: F.get(F.col("_words"), i + k)
    starts = F.when(
        F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)
    ).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(
        "_grams", F.transform(starts, lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)]))
    )
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.sort_array(
        F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    df = df.withColumn("_pairs", F.when(repeats, pairs))
    hash_at = lambda i: F.get(F.col("_pairs"), i)["h"]
    twice = lambda x, i: (
        (x["h"] == F.when(i > 0, hash_at(i - 1))) | (x["h"] == hash_at(i + 1))
    )
    places = F.transform(F.filter("_pairs", twice), lambda x: x["i"])
    df = df.withColumn("_at", F.sort_array(places))
    covered = F.transform(
        "_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(WINDOW)))
    )
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    with_word = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_full", with_word)
    count = lambda c: c.cast("bigint")
    return df.withColumns(
        {
            "n_words": count(F.size("_words")),
            "word_chars": count(F.char_length(F.array_join("_words", ""))),
            "n_symbols": count(F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))),
            "n_dup_lines": count(F.size("_full") - F.size(F.array_distinct("_full"))),
            "n_repeat_words": F.coalesce(total, F.lit(0).cast("bigint")),
        }
    ).drop("_grams", "_pairs", "_at", "_full", "_lines", "_words")


def line_fails(line: Column, rules: LineRules = RULES) -> Column:
    """Whether a line with words fails a rule."""
    w = common.words(line)
    n = F.size(w)
    separators = F.regexp_count(line, F.lit(r"(?:^|\s)(?:[|»›·•]|>>?|::)(?=\s|$)"))
    symbol_words = F.regexp_count(line, F.lit(f"(?:[{SYMBOLS}~^=_]{{3,}})(?=\\s|$)"))
    phrases = "|".join(p.replace(" ", r"\s+") for p in rules.phrases)
    return (
        (separators >= rules.separators)
        | (separators * 2 >= n)
        | (symbol_words > n * rules.symbol_words)
        | (line.rlike(f"(?i)\\b(?:{phrases})\\b") & (n <= rules.boilerplate_words))
        | ((n >= 10) & (F.size(F.array_distinct(w)) < n * rules.distinct_words))
    )


def clean(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """All documents with base counts, ``cleaned_text``, ``n_words_left``, ``base_failed``, ``kept``.

    ``base_failed``: fewer than ten words, or more than 20 % of the words in repeated windows of
    five. ``kept``: not base-failed, and at most half of the words lost with removed lines. A NULL
    text counts as empty and is rejected for its length. Lines without a word always stay. Columns
    of the input with the names of results are replaced; all others pass through. Rows are judged one by
    one: repeated rows get equal results, an empty table gives no rows.
    """
    results = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words cleaned_text n_words_left "
        "base_failed kept"
    ).split()
    docs = common.spare(docs, *results)
    based = base_columns(docs)
    stays = lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x, rules))
    left = based.withColumn(
        "cleaned_text", F.array_join(F.filter(common.lines("text"), stays), "\n")
    )
    left = left.withColumn("n_words_left", F.size(common.words("cleaned_text")).cast("bigint"))
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")
    )
    lost = F.col("n_words") - F.col("n_words_left")
    kept = ~failed & (lost <= F.col("n_words") * rules.lost_share)
    return left.withColumns({"base_failed": failed, "kept": kept}).select(*docs.columns, *results)


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    return clean(docs).drop("text", "cleaned_text")


def oracle() -> str:
    """The same in words: separators and stray symbols are told by whole words here."""
    r = RULES
    words = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
    has_word = "regexp_matches({}, '[^\\x20\\x09-\\x0D]')"
    phrases = "|".join(p.replace(" ", r"\s+") for p in r.phrases)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words.format("t")} AS w FROM documents),
        grams AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
            FROM (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d))
        ), repeats AS (
            SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM grams WHERE times > 1)
            GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
        ), worded AS (
            SELECT doc_id, line, {words.format("line")} AS lw, len(lw) AS n,
                   len(list_filter(lw, lambda x: x IN ('|', '»', '›', '·', '•', '>', '>>', '::'))) AS seps,
                   len(list_filter(lw, lambda x: regexp_matches(x, '[{SYMBOLS}~^=_]{{3,}}$'))) AS odd
            FROM lines WHERE {has_word.format("line")}
        ), judged AS (
            SELECT *, seps >= {r.separators} OR seps * 2 >= n OR odd > n * {r.symbol_words}
                OR (regexp_matches(line, '(?i)\\b(?:{phrases})\\b') AND n <= {r.boilerplate_words})
                OR (n >= 10 AND len(list_distinct(lw)) < n * {r.distinct_words}) AS fails
            FROM worded
        ), left_over AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
                   coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS words_left
            FROM judged GROUP BY doc_id
        ), counted AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words,
                   length(array_to_string(w, ''))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(words_left, 0)::BIGINT AS n_words_left
            FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN left_over USING (doc_id)
        )
        SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.repeat_percent} * n_words AS base_failed,
               NOT base_failed AND n_words - n_words_left <= n_words * {r.lost_share} AS kept
        FROM counted
    """
