"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.session import written

__all__ = ["ascii_lower", "digest", "lines", "read", "spare", "words", "written"]

# Words are cut at the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words(text: str | Column) -> Column:
    """The words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), WORD_GAP), "")


def lines(text: str | Column) -> Column:
    """The lines of a text; NULL and the empty text have one empty line."""
    return F.split(F.coalesce(_col(text), F.lit("")), "\n", -1)


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` alone does it for pure ASCII, and faster."""
    text = _col(text)
    only_ascii = F.octet_length(text) == F.char_length(text)
    changed = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(only_ascii, F.lower(text)).otherwise(changed)


def digest(text: str | Column, prefix: str = "_key") -> list[Column]:
    """Two 64-bit hashes that stand for a text: equal texts meet, others do not (128 bits)."""
    text = F.coalesce(_col(text), F.lit(""))
    return [
        F.xxhash64(text).alias(f"{prefix}1"),
        F.xxhash64(F.lit(7), text).alias(f"{prefix}2"),
    ]


def spare(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have the names of results (an input's own are replaced)."""
    wanted = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text
