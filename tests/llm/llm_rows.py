"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for a quiet party"
SHARED_LINE = "This very line stands in several documents."


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choice("abcdefghijklmnoprstuvwéß") for _ in range(rng.randint(2, 9))) for _ in range(n)
    )


def documents() -> list[tuple]:
    """NULLs in every column, empty and very long texts, copies, ties and repeated rows."""
    long_text = "\n".join(prose(1000 + i, 12) + "." for i in range(900))
    passage = prose(77, 80)
    texts = [
        (1, SENTENCE, "en", "a"),
        (2, SENTENCE.upper(), "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (5, " \t\n \x0b\f\r", "en", "b"),
        (6, long_text, "en", "c"),
        (7, f"{SHARED_LINE}\n{prose(7, 40)}\n{SHARED_LINE}", "en", "c"),
        (8, f"{prose(8, 40)}\n  {SHARED_LINE.upper()}\t\n{prose(9, 9)}", None, "c"),
        (9, f"{prose(10, 30)} {passage} {prose(11, 30)}", "de", "d"),
        (10, f"{prose(12, 20)} {passage} {prose(13, 25)} {passage}", "de", "d"),
        (11, passage, "de", "d"),
        (12, passage, "de", "d"),
        (12, passage, "de", "d"),
        (None, f"{SHARED_LINE}\n{prose(14, 30)}", "en", None),
        (None, f"{SHARED_LINE}\n{prose(14, 30)}", "en", None),
        (13, "one two", "en", "e"),
        (14, "ONE\xa0TWO Σας ΣΑΣ.b İstanbul K", "el", "e"),
        (15, "word " * 300, "en", "e"),
        (16, "x" * 1500, "en", "f"),
        (17, "a | b | c | d\n" + SENTENCE + ".\nAccept cookies", "en", "f"),
    ]
    texts += [(100 + i, prose(500 + i % 7, 60 + i), "en", "abcdef"[i % 6]) for i in range(40)]
    return [(i, t, lang, source, None if i == 5 else len(t or "")) for i, t, lang, source in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
