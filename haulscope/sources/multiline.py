"""CSV records whose quoted cells hold line breaks, read by as many tasks as the files have blocks.

A file is read as plain lines. Where a line stands, inside or outside a quoted cell, depends on all lines
before it; but what a line *does* does not: each is a function of two states (outside, inside) that
keeps them, swaps them, or sets one. Lines that keep both states are most of all, and are not
moved. The others are narrow rows: their functions are composed inside each block, the blocks' functions
over each file, and from that follows where every record starts. Only records of several lines are put
together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from haulscope.operators.joins import join_measured
from haulscope.session import settle, written

ANY_CASE = "*.[cC][sS][vV]"
# A quoted cell without an end would swallow all that follows: records of more lines are reported.
MAX_LINES = 10_000

# A quoted cell's text, a cell of any kind, and the rest of a line that has opened a cell and not closed it.
_TEXT = r'(?:[^"]++|"")*+'
_CELLS = rf'(?:(?:"{_TEXT}"[^,"][^,]*+|"{_TEXT}"|[^",][^,]*+|),)*+'
_OPENS = rf'{_CELLS}"{_TEXT}\z'


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of a line, given whether one is at its start.

    Quotes open a cell only where it starts and are doubled inside; what follows a closing quote up
    to the comma belongs to the cell and opens nothing.
    """
    if not inside:
        return line.rlike(rf"\A{_OPENS}")
    return line.rlike(rf"\A{_TEXT}\z") | line.rlike(rf'\A{_TEXT}"(?:[^,"][^,]*+)?,{_OPENS}')


# Windows-1252 where it differs from Latin-1: the 32 codes from 0x80 on, by Python's own table.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def raw_lines(spark: SparkSession, folder: str, glob: str = ANY_CASE) -> DataFrame:
    """Every line (value, as the bytes in the file, decoded or not), with its file and block."""
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob)
    return reader.text(folder).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def file_encodings(lines: DataFrame) -> DataFrame:
    """Per file of raw lines: ``lines``, ``not_utf8`` (lines that are no UTF-8), and ``encoding``: UTF-8 if all lines
    are, else windows-1252, in which every byte is a character. One pass, a row a file and task."""
    wrong = F.count(F.when(~F.is_valid_utf8("value"), 1))
    found = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), wrong.alias("not_utf8"))
    return found.withColumn("encoding", F.when(F.col("not_utf8") == 0, "UTF-8").otherwise("windows-1252"))


def decoded(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """Raw lines as text, each file by its own encoding."""
    windows = encodings.where(F.col("encoding") != "UTF-8").select("file", F.lit(True).alias("windows"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    found = join_measured(lines, windows, "file", "left")
    text = F.when(F.col("windows"), F.translate(latin, _LATIN, _WINDOWS)).otherwise(F.col("value"))
    return found.withColumn("value", text).drop("windows")


def read_lines(spark: SparkSession, folder: str, glob: str = ANY_CASE) -> DataFrame:
    """Every line of the files (value, file, block, line): ``line`` counts from 1 per file.

    Lines end at a line feed; a carriage return before it is kept. Each file is decoded by what its
    bytes are (see ``file_encodings``). Files are read block by block, twice; the lines are stored once,
    so that numbers do not depend on a later scan.
    """
    raw = raw_lines(spark, folder, glob)
    placed = decoded(raw.withColumn("read_order", F.monotonically_increasing_id()), settle(file_encodings(raw)))
    return numbered(written(placed, "lines"))


def numbered(lines: DataFrame) -> DataFrame:
    """Line numbers without moving the lines: counts of blocks become the blocks' starts."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("read_order").alias("first"))
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    found = join_measured(lines, blocks, ["file", "block"], "inner")
    return found.withColumn("line", F.col("read_order") + F.col("shift")).drop("read_order", "shift")


def record_spans(lines: DataFrame) -> DataFrame:
    """Records of several lines (file, first, last), from 1 per file; ``last`` is NULL where the quoted
    cell is never closed."""
    acts = lines.where(F.contains("value", F.lit('"'))).select(
        "file",
        "block",
        "line",
        ends_inside(F.col("value"), False).alias("from_out"),
        ends_inside(F.col("value"), True).alias("from_in"),
    )
    # Lines that keep both states do nothing.
    acts = settle(acts.where(F.col("from_out") | ~F.col("from_in")))

    def composed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Per row what it and the rows before it do: ``sets`` (the state that the last setting row left,
        NULL if none) and ``swaps`` (whether the rows since have swapped it)."""
        upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        swaps = F.sum(F.col("swap").cast("bigint")).over(upto)
        at_set = F.when(F.col("sets").isNotNull(), F.struct("sets", F.col("total").alias("total")))
        last = F.last(at_set, ignorenulls=True).over(upto)
        rows = rows.withColumn("total", swaps).withColumn("last", last)
        since = (F.col("total") - F.coalesce("last.total", F.lit(0))) % 2 == 1
        return rows.withColumns({"sets": F.col("last.sets"), "swaps": since}).drop("last", "total", "swap")

    constant = F.col("from_out") == F.col("from_in")
    acts = acts.select(
        "file",
        "block",
        "line",
        F.when(constant, F.col("from_out")).alias("sets"),
        (F.col("from_out") & ~F.col("from_in")).alias("swap"),
    )
    inner = composed(acts, ["file", "block"], "line")
    per_block = inner.groupBy("file", "block").agg(F.max_by(F.struct("sets", "swaps"), "line").alias("f"))
    per_block = per_block.select(
        "file",
        "block",
        # Setting and swapping after it is setting the other state.
        F.when(F.col("f.sets").isNotNull(), F.col("f.sets") != F.col("f.swaps")).alias("sets"),
        (F.col("f.sets").isNull() & F.col("f.swaps")).alias("swap"),
    )
    outer = composed(per_block, ["file"], "block")
    after = F.coalesce("sets", F.lit(False)) != F.col("swaps")
    before = F.lag(after, 1, False).over(W.partitionBy("file").orderBy("block"))
    opened = settle(outer.select("file", "block", before.alias("opened")))
    states = join_measured(inner, opened, ["file", "block"], "inner").select(
        "file", "block", "line", (F.coalesce("sets", "opened") != F.col("swaps")).alias("inside")
    )
    # Where the state changes: a record opens with the first line that ends inside, and ends with the
    # first one after it that ends outside. Per block first, then at the edges of blocks.
    own = W.partitionBy("file", "block").orderBy("line")
    changes = states.withColumn("was", F.lag("inside").over(own))
    changes = join_measured(changes, opened, ["file", "block"], "inner")
    changes = changes.where(F.col("inside") != F.coalesce("was", "opened")).select("file", "block", "line", "inside")
    nexts = changes.withColumn("next", F.lead("line").over(own))
    firsts = changes.groupBy("file", "block").agg(F.min("line").alias("first_change"))
    later = F.lead("first_change").over(W.partitionBy("file").orderBy("block"))
    edges = firsts.select("file", "block", later.alias("later"))
    found = join_measured(nexts, edges, ["file", "block"], "inner")
    return found.where("inside").select(
        "file", F.col("line").alias("first"), F.coalesce("next", "later").alias("last")
    )


def read_records(spark: SparkSession, folder: str, max_lines: int = MAX_LINES, glob: str = ANY_CASE) -> DataFrame:
    """Every record of the files: file, first and last line (from 1), record (text), and ``problem``.

    A record that a quoted cell keeps open over more than ``max_lines`` lines, or to the end of the file,
    is reported at its first line, with that line as its text; its other lines are not put together.
    Lines without any text outside a quoted cell are left out.
    """
    lines = read_lines(spark, folder, glob)
    # Two or more lines each: never more rows than odd lines.
    spans = settle(record_spans(lines))
    length = F.col("last") - F.col("first") + 1
    closed = spans.where(length <= max_lines)
    members = closed.select("file", "first", "last", F.explode(F.sequence("first", "last")).alias("line"))
    broken = spans.where(F.col("last").isNull() | (length > max_lines))
    swallowed = broken.select(F.col("file").alias("b_file"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))

    tagged = join_measured(lines, members, ["file", "line"], "left")
    text = F.regexp_replace("value", r"\r\z", "")
    parts = tagged.where(F.col("first").isNotNull()).groupBy("file", "first").agg(
        F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts")
    )
    many = parts.select(
        "file", "first", "last", F.regexp_replace(F.array_join("parts.value", "\n"), r"\r\z", "").alias("record"),
        F.lit(None).cast("string").alias("problem"),
    )
    alone = tagged.where(F.col("first").isNull())
    inside = (
        (F.col("file") == F.col("b_file"))
        & (F.col("line") >= F.col("b_first"))
        & (F.col("line") <= F.coalesce("b_last", F.lit(2**62)))
    )
    # One row for each cell that is never closed (one a file at most) or is too long.
    alone = join_measured(alone, swallowed, inside, "left")
    kept = alone.where(F.col("b_first").isNull() | (F.col("line") == F.col("b_first")))
    problem = F.when(
        F.col("b_first").isNotNull(),
        F.when(F.col("b_last").isNull(), F.concat(F.lit("quoted cell opened in line "), "line", F.lit(" is never closed")))
        .otherwise(F.concat(F.lit("record of line "), "line", F.lit(f" has more than {max_lines} lines"))),
    )
    single = kept.where((text != "") | F.col("b_first").isNotNull()).select(
        "file", F.col("line").alias("first"), F.col("line").alias("last"), text.alias("record"), problem.alias("problem")
    )
    return single.unionByName(many)
