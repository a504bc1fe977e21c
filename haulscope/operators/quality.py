"""Upload checks as column expressions: one narrow pass over the rows.

A check says which rows fail and what to tell about them. Counting failures only evaluates the
conditions; messages are put together for failed rows alone. Row numbers count lines of the
file, the header being line 1. The ``rule`` code is the key; message texts are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haulscope.functions.dates import parse_date
from haulscope.functions.numeric import count_where, parse_number, plain, thousands
from haulscope.functions.text import is_blank, is_missing
from haulscope.operators.joins import join_measured
from haulscope.schemas import STATE_CODES, UPLOAD_COLUMNS
from haulscope.sources.files import CORRUPT

ERROR, WARNING = "error", "warning"

# Ranges, and the smallest upload worth taking.
NUMBER_RANGES = {"weight_lbs": (0, 200_000), "miles": (0, 5_000)}
NOT_NEGATIVE = ("base_freight_usd", "accessorial_charge_usd")
REQUIRED_TEXT = ("shipment_id", "carrier", "facility")
SMALLEST_UPLOAD = 10

ISSUES, ERRORS, WARNINGS = "issues", "n_errors", "n_warnings"
NUMERIC = (*NUMBER_RANGES, *NOT_NEGATIVE)


@dataclass(frozen=True)
class Check:
    severity: str
    rule: str
    failed: Column
    message: Column


def _check(failed: Column, severity: str, rule: str, *parts: str | Column) -> Check:
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    message = F.concat(F.lit("Row "), F.col("row_num").cast("string"), F.lit(": "), *pieces)
    return Check(severity, rule, F.coalesce(failed, F.lit(False)), message)


def _number(name: str) -> Column:
    """The parsed cell, computed once per row by ``check``."""
    return F.col(f"_{name}_number")


def _date() -> Column:
    return F.col("_ship_date_parsed")


def _parsed(df: DataFrame) -> dict[str, Column]:
    cells = {f"_{n}_number": parse_number(n) for n in NUMERIC if n in df.columns}
    if "ship_date" in df.columns:
        cells["_ship_date_parsed"] = parse_date("ship_date")
    return cells


# --- the frame ------------------------------------------------------------------------------


def frame_issues(df: DataFrame, expected: Sequence[str] = UPLOAD_COLUMNS) -> list[dict[str, str]]:
    """Missing columns (one error) and unknown ones (one warning); looks at names only."""
    helpers = {"row_num", "file", CORRUPT}
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected and c not in helpers]
    found = []
    if missing:
        text = f"Missing required column(s): {', '.join(missing)}"
        found.append({"severity": ERROR, "rule": "missing_columns", "message": text})
    if extra:
        text = f"Column(s) will be ignored: {', '.join(extra)}"
        found.append({"severity": WARNING, "rule": "extra_columns", "message": text})
    return found


def size_issue(df: DataFrame, smallest: int = SMALLEST_UPLOAD) -> dict[str, str] | None:
    """Empty or too small an upload (reads at most ``smallest`` rows)."""
    rows = df.limit(smallest).count()
    if rows == 0:
        text = (
            "CSV file is empty - no data rows found. "
            f"Please upload a file with at least {smallest} shipment records."
        )
        return {"severity": ERROR, "rule": "empty_file", "message": text}
    if rows < smallest:
        text = f"Please upload a file with at least {smallest} shipment records."
        return {"severity": WARNING, "rule": "small_file", "message": text}
    return None


def frame_messages(
    spark: SparkSession, df: DataFrame, expected: Sequence[str] = UPLOAD_COLUMNS
) -> DataFrame:
    """``frame_issues`` and ``size_issue`` as a frame: severity, rule, message."""
    found = [*frame_issues(df, expected), size_issue(df)]
    rows = [(f["severity"], f["rule"], f["message"]) for f in found if f]
    return spark.createDataFrame(rows, "severity string, rule string, message string")


# --- row checks -----------------------------------------------------------------------------


def standard_checks() -> list[Check]:
    """The checks every upload goes through, in reporting order."""
    checks = [
        _check(is_blank(name), ERROR, f"{name}_missing", f"'{name}' is empty or missing.")
        for name in REQUIRED_TEXT
    ]
    # A missing date is let through; any other text that is no date fails, white space included.
    bad_date = ~is_missing("ship_date") & _date().isNull()
    checks.append(
        _check(
            bad_date, ERROR, "ship_date_invalid",
            "'ship_date' value '", F.col("ship_date"), "' is not a valid date.",
        )
    )
    for name, (low, high) in NUMBER_RANGES.items():
        number = _number(name)
        outside = is_missing(name) | ~number.between(low, high)
        checks.append(
            _check(
                outside, ERROR, f"{name}_range",
                f"'{name}' value ", thousands(number), f" is out of range ({low:,}–{high:,}).",
            )
        )
        checks.append(_not_a_number(name, number))
    for name in NOT_NEGATIVE:
        number = _number(name)
        checks.append(
            _check(number < 0, ERROR, f"{name}_negative", f"'{name}' cannot be negative.")
        )
        checks.append(_not_a_number(name, number))
    checks.append(
        _check(
            is_blank("accessorial_charge_usd"), WARNING, "accessorial_charge_usd_blank",
            "'accessorial_charge_usd' is blank — defaulted to 0.",
        )
    )
    return checks


def _not_a_number(name: str, number: Column) -> Check:
    bad = ~is_missing(name) & number.isNull()
    return _check(bad, ERROR, f"{name}_not_number", f"'{name}' is not a number.")


def date_required() -> Check:
    return _check(is_blank("ship_date"), ERROR, "ship_date_missing", "'ship_date' is empty or missing.")


def positive_miles() -> Check:
    return _check(
        _number("miles") <= 0, ERROR, "miles_not_positive", "Distance must be greater than 0"
    )


def long_distance(limit: float = 5000, severity: str = WARNING) -> Check:
    number = _number("miles")
    return _check(
        number > limit, severity, "miles_long",
        "Distance of ", plain(number), " miles exceeds typical US range. Verify accuracy.",
    )


def future_date(as_of: date | str) -> Check:
    return _check(
        _date() > F.lit(str(as_of)).cast("timestamp_ntz"), WARNING, "ship_date_future",
        "Future date detected. Use only historical data for training.",
    )


def in_domain(name: str, options: Sequence[str]) -> Check:
    listed = ", ".join(options)
    return _check(
        ~is_blank(name) & ~F.col(name).isin(list(options)), ERROR, f"{name}_unknown",
        f"'{name}' value '", F.col(name), f"' is not one of: {listed}.",
    )


def with_reference(df: DataFrame, name: str, reference: DataFrame, column: str | None = None) -> DataFrame:
    """``df`` with ``_<name>_unknown``: whether the cell is a value that the reference table's column lacks.

    Values are counted first and looked up once each, however often one occurs; the unknown ones, which
    are few as a rule, are marked where the rows lie (runs jobs: see ``join_measured``). The check is
    ``in_reference``.
    """
    used = df.where(~is_blank(name)).select(F.col(name).alias("_value")).groupBy("_value").agg(F.count(F.lit(1)).alias("rows"))
    known = reference.select(F.col(column or name).alias("_value")).where(F.col("_value").isNotNull()).distinct()
    unknown = used.join(known, "_value", "left_anti").select("_value", F.lit(True).alias(f"_{name}_unknown"))
    marked = join_measured(df, unknown, F.col(name) == F.col("_value"), "left").drop("_value")
    return marked.withColumn(f"_{name}_unknown", F.coalesce(f"_{name}_unknown", F.lit(False)))


def in_reference(name: str, table: str) -> Check:
    """For rows that went through ``with_reference``; ``table`` is what messages call the reference."""
    return _check(
        F.col(f"_{name}_unknown"), ERROR, f"{name}_unknown",
        f"'{name}' value '", F.col(name), f"' is not in {table}.",
    )


def state_code(name: str, codes: Sequence[str] = STATE_CODES) -> Check:
    value = F.coalesce(F.col(name), F.lit(""))
    return _check(
        ~value.isin(list(codes)), ERROR, f"{name}_state",
        "Invalid state code '", value, "'. Use 2-letter abbreviation.",
    )


def whole_cents(name: str) -> Check:
    """Amounts are summed in cents; more digits than two would be rounded away."""
    number = _number(name) * 100
    off = F.abs(number - F.rint(number)) > F.greatest(F.abs(number), F.lit(1.0)) * 1e-9
    return _check(off, WARNING, f"{name}_digits", f"'{name}' has more than two decimal digits.")


def encoding_damage(*names: str) -> Check:
    """A replacement character means that bytes could not be decoded."""
    damaged = F.lit(False)
    for name in names:
        damaged = damaged | F.coalesce(F.contains(F.col(name), F.lit("�")), F.lit(False))
    return _check(
        damaged, WARNING, "encoding", "Special characters detected - ensure file is UTF-8 encoded"
    )


def malformed_line() -> Check:
    return _check(F.col(CORRUPT).isNotNull(), ERROR, "malformed_line", "line could not be parsed.")


def missing_tier() -> Check:
    return _check(
        is_blank("risk_tier"), WARNING, "risk_tier_default", "'risk_tier' defaulted to 'Low'"
    )


def cost_without_flag(cost: str, flag: str) -> Check:
    return _check(
        _contradiction(cost, flag), WARNING, "flag_corrected",
        "Cost present but flag is 'No'. Auto-correcting flag to 'Yes'.",
    )


# --- results --------------------------------------------------------------------------------


def check(df: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """Add ``n_errors``, ``n_warnings`` and the ``issues`` array; needs a ``row_num`` column.

    Cells are parsed once, in a projection below the conditions. The counts come out of a
    one-row generator: a filter on them stays above it, where it compares two integers. A plain
    column would be pushed down, and every cell parsed again for each place that names it.
    """
    used = standard_checks() if checks is None else checks
    cells = _parsed(df)

    def failures(severity: str) -> Column:
        return reduce(add, [c.failed.cast("int") for c in used if c.severity == severity], F.lit(0))

    issues = [
        F.when(
            c.failed,
            F.struct(
                F.lit(c.severity).alias("severity"),
                F.lit(c.rule).alias("rule"),
                c.message.alias("message"),
            ),
        )
        for c in used
    ]
    counts = F.struct(failures(ERROR).alias(ERRORS), failures(WARNING).alias(WARNINGS))
    counted = df.withColumns(cells).select("*", F.inline(F.array(counts)))
    listed = F.filter(F.array(*issues), lambda issue: issue.isNotNull())
    return counted.withColumn(ISSUES, listed).drop(*cells)


def _plain(checked: DataFrame) -> DataFrame:
    return checked.drop(ISSUES, ERRORS, WARNINGS)


def messages(checked: DataFrame) -> DataFrame:
    """One row per message; ``position`` orders the messages of a row.

    Failed rows have at least one issue, so the outer form lists the same rows; for the inner
    form Spark would also filter on the array's size, below the counts.
    """
    failed = checked.where(F.col(ERRORS) + F.col(WARNINGS) > 0)
    listed = failed.select("row_num", "shipment_id", F.posexplode_outer(ISSUES))
    return listed.select(
        "row_num",
        "shipment_id",
        F.col("pos").alias("position"),
        F.col("col.severity").alias("severity"),
        F.col("col.rule").alias("rule"),
        F.col("col.message").alias("message"),
    )


def first_messages(
    df: DataFrame,
    checks: Sequence[Check] | None = None,
    severity: str = ERROR,
    rows: int = 50,
) -> DataFrame:
    """The first ``rows`` messages of an unchecked upload and how many there are beyond them.

    All rows are only counted. The first ``rows`` failed rows hold the first messages, so
    messages are put together for those alone.
    """
    count = {ERROR: ERRORS, WARNING: WARNINGS}[severity]
    checks = standard_checks() if checks is None else checks
    counted = check(df, checks).select(*df.columns, count)
    found = F.coalesce(F.sum(count), F.lit(0))
    beyond = counted.agg(F.greatest(found - rows, F.lit(0)).alias("more")).scalar()
    candidates = counted.where(F.col(count) > 0).orderBy("row_num").limit(rows).drop(count)
    first = messages(check(candidates, checks)).where(F.col("severity") == severity)
    first = first.orderBy("row_num", "position").limit(rows)
    return first.select("row_num", "rule", "message", beyond.alias("more"))


def summary(checked: DataFrame) -> DataFrame:
    """Counts, both readings of "rows passed", and whether scoring may start."""
    counted = checked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(ERRORS), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(WARNINGS), F.lit(0)).alias("warnings"),
        count_where(F.col(ERRORS) == 0).alias("rows_without_error"),
    )
    return counted.select(
        "rows",
        "errors",
        "warnings",
        (F.col("rows") - F.col("errors")).alias("rows_passed_ref"),
        "rows_without_error",
        (F.col("errors") == 0).alias("may_score"),
    )


def clean_rows(checked: DataFrame) -> DataFrame:
    """Rows without an error; warnings do not hold a row back."""
    return _plain(checked.where(F.col(ERRORS) == 0))


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(ERRORS) > 0)


def may_score(checked: DataFrame) -> bool:
    """The upload as a whole passes (runs until the first error is found)."""
    return quarantined_rows(checked).isEmpty()


def first_rows(df: DataFrame, rows: int = 25) -> DataFrame:
    return df.orderBy("row_num").limit(rows)


# --- corrections ----------------------------------------------------------------------------


def _contradiction(cost: str, flag: str) -> Column:
    return (F.col(cost) > 0) & ~F.col(flag).cast("boolean")


def correct_flag(df: DataFrame, cost: str, flag: str) -> DataFrame:
    """Set the flag where a cost is present; ``flag_was_corrected`` marks those rows."""
    wrong = F.coalesce(_contradiction(cost, flag), F.lit(False))
    kind = dict(df.dtypes)[flag]
    fixed = F.when(wrong, F.lit(True)).otherwise(F.col(flag).cast("boolean"))
    return df.withColumns({flag: fixed.cast(kind), "flag_was_corrected": wrong})


def default_tier(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "risk_tier", F.when(is_blank("risk_tier"), F.lit("Low")).otherwise(F.col("risk_tier"))
    )


# --- carrier spelling and references --------------------------------------------------------


def spellings(df: DataFrame, column: str = "carrier") -> DataFrame:
    """Every spelling with its count, its normal form, and the spelling to use.

    Spellings that differ only in case and surrounding space share a normal form; the most
    frequent one wins, ties to the smallest. Counts come first, so what is joined is one row
    per spelling however often it occurs.
    """
    counted = (
        df.where(~is_blank(column))
        .groupBy(F.col(column).alias("spelling"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("normal", F.lower(F.trim("spelling")))
    )
    chosen = counted.groupBy("normal").agg(
        F.count(F.lit(1)).alias("variants"),
        F.min_by("spelling", F.struct(-F.col("rows"), F.col("spelling"))).alias("canonical"),
    )
    return counted.join(chosen, "normal")


def near_duplicates(df: DataFrame, column: str = "carrier") -> DataFrame:
    return spellings(df, column).where(F.col("variants") > 1)


def unify_spelling(df: DataFrame, column: str = "carrier") -> DataFrame:
    """Replace every spelling by its canonical one (runs jobs: see ``join_measured``)."""
    mapping = spellings(df, column).select(
        F.col("spelling").alias("_spelling"), F.col("canonical").alias("_canonical")
    )
    joined = join_measured(df, mapping, F.col(column) == F.col("_spelling"), "left")
    unified = joined.withColumn(column, F.coalesce("_canonical", column))
    return unified.drop("_spelling", "_canonical")


def orphan_carriers(shipments: DataFrame, carriers: DataFrame) -> DataFrame:
    """Carrier ids on shipments that no carrier has, with their shipment counts.

    Counted before the anti join, so a hot id is one row by then.
    """
    used = (
        shipments.where(F.col("CarrierId").isNotNull())
        .groupBy(F.col("CarrierId").alias("carrier_id"))
        .agg(F.count(F.lit(1)).alias("shipments"))
    )
    return used.join(carriers.select("carrier_id"), "carrier_id", "left_anti")


def complete_carriers(shipments: DataFrame, carriers: DataFrame) -> DataFrame:
    """Carriers plus an entry without details for every orphan id."""
    missing = orphan_carriers(shipments, carriers).select("carrier_id")
    return carriers.unionByName(missing, allowMissingColumns=True)


# --- duplicate ids --------------------------------------------------------------------------


def duplicate_ids(df: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Ids on more than one row: occurrences, first and last row number."""
    found = df.where(~is_blank(key)).groupBy(key).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min("row_num").alias("first_row"),
        F.max("row_num").alias("last_row"),
    )
    return found.where(F.col("occurrences") > 1)


def duplicate_rows(df: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Every row whose id occurs more than once (runs jobs: see ``join_measured``)."""
    found = duplicate_ids(df, key).select(key, "occurrences")
    return join_measured(df, found, key, "inner")


def keep_one(df: DataFrame, keep: str = "first", key: str = "shipment_id") -> DataFrame:
    """One row per id, the first or the last; rows without an id all stay.

    Only ids and row numbers are shuffled to find the duplicates; the rows themselves meet the
    list of duplicated ids in place, as long as that list is small (runs jobs: see
    ``join_measured``).
    """
    kept = duplicate_ids(df, key).select(
        F.col(key).alias("_id"), F.col(f"{keep}_row").alias("_kept_row")
    )
    joined = join_measured(df, kept, F.col(key) == F.col("_id"), "left")
    stays = F.col("_kept_row").isNull() | (F.col("row_num") == F.col("_kept_row"))
    return joined.where(stays).drop("_id", "_kept_row")


def resolve_duplicates(
    existing: DataFrame, incoming: DataFrame, policy: str, key: str = "shipment_id"
) -> DataFrame:
    """Add an upload to existing rows: ``skip`` or ``update`` ids that are already there, or
    ``cancel`` (raise) if any id occurs twice.

    The upload's ids are computed once. While they are few, the existing rows meet them in place
    and are not shuffled (runs jobs: see ``join_measured``).
    """
    columns = existing.columns
    if policy not in ("skip", "update", "cancel"):
        raise ValueError(f"unknown policy {policy!r}")
    ids = incoming.where(F.col(key).isNotNull()).select(key).distinct()
    if policy == "update":
        newest = keep_one(incoming, "last", key).select(*columns)
        return join_measured(existing, ids, key, "left_anti").unionByName(newest)
    # Ids of the upload that are there already: no more rows than the upload has.
    present = join_measured(existing.select(key), ids, key, "left_semi").distinct()
    if policy == "skip":
        added = join_measured(keep_one(incoming, "first", key), present, key, "left_anti")
        return existing.unionByName(added.select(*columns))
    if not duplicate_ids(incoming, key).isEmpty() or not present.isEmpty():
        raise ValueError("upload cancelled: duplicate shipment ids")
    return existing.unionByName(incoming.select(*columns))
