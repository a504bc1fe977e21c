"""Upload files: acceptance, reading with line numbers, and result files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from haulscope.operators.joins import join_measured
from haulscope.session import settle, written
from haulscope.sources import multiline

# Accepted extension, size limit, and the texts of a refusal.
EXTENSION = ".csv"
ANY_CASE = "*.[cC][sS][vV]"
MAX_BYTES = 10 * 1024 * 1024
REFUSED_EXTENSION = "Only .csv files are supported. Please export as CSV format."
REFUSED_SIZE = "File size exceeds {limit}MB limit. Please split into smaller files."

# Cell texts that mean "no value" in an upload.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CORRUPT = "_corrupt_record"
ENCODING_ADVICE = "The file was read as Windows-1252; save it as UTF-8."

# Block offsets up to this size are broadcast (they also take that much of the driver's heap);
# it is enough for about 25 TB in blocks of 128 MB with paths of 200 characters.
BROADCAST_BLOCK_BYTES = 64 * 1024 * 1024


def file_report(spark: SparkSession, folder: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """One row per file: path, bytes, accepted, reason. File contents are not opened."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    wrong_kind = ~F.lower("path").endswith(EXTENSION)
    reason = F.when(wrong_kind, F.lit(REFUSED_EXTENSION))
    if max_bytes is not None:
        refusal = F.lit(REFUSED_SIZE.format(limit=max_bytes // (1024 * 1024)))
        reason = reason.when(F.col("length") > max_bytes, refusal)
    return files.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


def header_of(spark: SparkSession, folder: str) -> list[str]:
    """Column names of the first line found (one-row job)."""
    reader = spark.read.option("header", True).option("pathGlobFilter", ANY_CASE)
    return reader.csv(folder).columns


def read_upload(
    spark: SparkSession,
    folder: str,
    columns: list[str] | None = None,
    *,
    encoding: str = "UTF-8",
    max_bytes: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """All cells as text, plus ``_corrupt_record``, ``file`` and ``row_num``.

    Every file must carry the same header; a different one is an error, not a silent shift. A
    file over ``max_bytes``, if a limit is given, is an error too. ``row_num`` is the line number
    with the header as line 1, counted per file. With ``multi_line`` a quoted cell may hold line
    breaks: a record then counts as one line however many it takes, and a file is read by one task.

    The files are parsed when this is called, once: the cells go to the shared work folder with
    their places, so that numbers do not depend on how a later scan would split the files.
    """
    if max_bytes is not None:
        report = file_report(spark, folder, max_bytes)
        big = report.where(F.lower("path").endswith(EXTENSION) & ~F.col("accepted")).first()
        if big:
            raise ValueError(f"{big['reason']} ({big['path']})")
    names = columns or header_of(spark, folder)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned parse would not notice a line that is short or long elsewhere.
        .option("columnPruning", False)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", ANY_CASE)
        .csv(folder)
    )
    # Spark refuses queries over nothing but the corrupt record, so it is tied to a cell.
    some_cell = F.length(F.coalesce(F.col(names[0]), F.lit(""))) >= 0
    # The source keeps the lines of one block in order inside one partition.
    placed = raw.select(
        *[_missing_to_null(F.col(n)).alias(n) for n in names],
        F.when(some_cell, F.col(CORRUPT)).alias(CORRUPT),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("read_order"),
    )
    return _number_lines(written(placed, "upload")).drop("block", "read_order")


def read_quoted(
    spark: SparkSession, folder: str, columns: list[str] | None = None, *, header: bool = True, glob: str = ANY_CASE
) -> DataFrame:
    """As ``read_upload``, for large files whose quoted cells may hold line breaks: files are split.

    ``row_num`` is the line in which a record starts and ``last_line`` the one in which it ends. Quotes
    inside quoted cells are doubled. A quoted cell that is never closed, or one of more than
    ``multiline.MAX_LINES`` lines, is a corrupt record at its first line; the lines it would swallow are
    left out. Lines without text are left out. Files are UTF-8 or else Windows-1252, each by its bytes.
    Every file must carry the same header, or none (``header=False``, with ``columns`` given).
    """
    records = written(multiline.read_records(spark, folder, glob=glob), "records")
    rows, names = records, columns or []
    if header:
        heads = records.groupBy("file").agg(F.min_by("record", "first").alias("head"), F.min("first").alias("at"))
        heads = settle(heads)
        seen = [r[0] for r in heads.select("head").distinct().limit(2).collect()]
        if len(seen) > 1:
            raise ValueError(f"files with different headers: {seen[0]!r} and {seen[1]!r}")
        names = names or (next(csv.reader([seen[0]])) if seen else [])
        rows = join_measured(records, heads.select("file", "at"), "file", "inner").where(F.col("first") != F.col("at"))
    if not names:
        raise ValueError(f"no columns for {folder}")
    fields = [T.StructField(n, T.StringType()) for n in (*names, CORRUPT)]
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "multiLine": "true",
        "maxCharsPerColumn": "-1",
    }
    schema = ", ".join(f"`{f.name}` string" for f in fields)
    parsed = rows.withColumn("cells", F.from_csv("record", F.lit(schema), options))
    broken = F.coalesce(F.col(f"cells.{CORRUPT}"), F.when(F.col("problem").isNotNull(), F.col("record")))
    return parsed.select(
        *[F.when(broken.isNull(), _missing_to_null(F.col(f"cells.`{n}`"))).alias(n) for n in names],
        broken.alias(CORRUPT),
        "file",
        F.col("first").alias("row_num"),
        F.col("last").alias("last_line"),
        "problem",
    )


def encoding_messages(spark: SparkSession, folder: str, glob: str = ANY_CASE) -> DataFrame:
    """One row a file that is not UTF-8: file, severity, rule, message."""
    found = multiline.file_encodings(multiline.raw_lines(spark, folder, glob)).where(F.col("not_utf8") > 0)
    return found.select(
        "file",
        F.lit("warning").alias("severity"),
        F.lit("encoding").alias("rule"),
        F.concat(F.col("not_utf8"), F.lit(" of "), F.col("lines"), F.lit(f" lines are not UTF-8. {ENCODING_ADVICE}")).alias("message"),
    )


def _missing_to_null(cell: Column) -> Column:
    return F.when(~cell.isin(list(MISSING_TEXTS)), cell)


def _number_lines(placed: DataFrame) -> DataFrame:
    """Contiguous numbers without moving the rows: block counts become block offsets.

    ``placed`` is stored, so places are data and the same for both passes. What is shuffled, and
    then broadcast, is one row per (file, block); the window runs per file on those.
    """
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("file", "block")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("read_order").alias("first_read"))
        .select(
            F.col("file").alias("o_file"),
            F.col("block").alias("o_block"),
            "first_read",
            F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
        )
    )
    same_block = (F.col("file") == F.col("o_file")) & (F.col("block") == F.col("o_block"))
    known = F.col("lines_before") + F.col("read_order") - F.col("first_read") + 2
    number = F.coalesce(known, F.raise_error(F.lit("a line without its block")).cast("bigint"))
    return (
        join_measured(placed, offsets, same_block, "left", limit=BROADCAST_BLOCK_BYTES)
        .withColumn("row_num", number)
        .drop("o_file", "o_block", "first_read", "lines_before")
    )


def append_parquet(df: DataFrame, folder: str, partition_by: str | None = None) -> None:
    """Bulk append; every task writes its own files."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    """Result export with a header line in each part file."""
    writer = df.write.mode("errorifexists").option("header", True)
    # Cells go out as they are, white space at their ends included.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
