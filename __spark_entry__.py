"""Entry points: a flagship query, the registry of queries, and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import lru_cache

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import oracle
from haulscope import FreightTables, Selection
from haulscope.functions import text
from haulscope.functions.dates import us_date
from haulscope.functions.numeric import half_even, parse_number
from haulscope.operators import (
    cost_model, enrich, filters, guards, quality, ranges, ranking, scoring,
)
from haulscope.plans import accessorials, carriers, costs, overview, routes, shipments, weekly
from haulscope.session import cleaned, work_folder
from haulscope.sources import files, star_schema, stored
from haulscope.sources.tables import or_else, preview

try:
    from haulscope.llm import registry as llm
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith("haulscope.llm"):
        raise
    llm = None
try:
    import corpus_pipeline
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("haulscope.llm", "corpus_pipeline")):
        raise
    corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

# Selections of the filtered queries; the SQL side states the same conditions.
SOME_CARRIERS = ("Supplier#000000001", "Supplier#000000004", "Supplier#000000007")
CHOSEN = Selection("1996-01-01", "1998-12-31", carriers=SOME_CARRIERS, tiers=("High", "Medium"))
LISTED = Selection(
    "1996-01-01", "1998-12-31", SOME_CARRIERS, ("BUILDING", "MACHINERY"), ("High", "Medium")
)
LINES_CHOSEN = Selection(
    "1996-01-01", "1999-12-31", SOME_CARRIERS, charge_types=("Detention", "Layover")
)
NOBODY = Selection(carriers=("no such carrier",))
NO_LINES = Selection(charge_types=("no such type",))
WATCHED = (("Supplier#000000003", "Supplier#000000008"), ("MACHIN", "HOUSE"))
YARDS = ("BUILDING", "MACHINERY", "FURNITURE")


def entry(spark: SparkSession) -> DataFrame:
    """Which carrier costs most per mile, and how risky is it?"""
    return carriers.carrier_metrics(_tables(spark, "/root/testdata/sf0.001"))


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, folder: str) -> star_schema.StarSchemaTables:
    """Table definitions (no data), set up once per session and folder."""
    return star_schema.StarSchemaTables(spark, folder)


def _on_tables(plan: Callable[[FreightTables], DataFrame]) -> Query:
    return lambda spark, folder: plan(_tables(spark, folder))


def _on_uploads(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(star_schema.upload_rows(spark, folder))


def _on_checked(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_uploads(lambda rows: plan(quality.check(rows)))


# --- queries that need more than one line ---------------------------------------------------


def _preview(spark: SparkSession, folder: str) -> DataFrame:
    _tables(spark, folder).shipments.createOrReplaceTempView("some_shipments")
    return preview(spark, "some_shipments")


def _fallback(t: FreightTables) -> DataFrame:
    return or_else(shipments.shipment_list(t, NOBODY), shipments.shipment_list(t))


def _by_weight(t: FreightTables) -> DataFrame:
    return ranking.sort_by(shipments.shipment_list(t), "weight_lbs", ascending=False)


def _lane_labels(t: FreightTables) -> DataFrame:
    ends = enrich.shipment_view(t.shipments).select("lane").distinct()
    return ends.select(text.shorten("lane", 15).alias("label"), "lane")


def _total_basis(t: FreightTables) -> DataFrame:
    return enrich.shipment_view(t.shipments, basis="total").select("shipment_id", "cost_per_mile")


def _strict_messages(rows: DataFrame) -> DataFrame:
    checks = [
        *quality.standard_checks(),
        quality.date_required(),
        quality.positive_miles(),
        quality.long_distance(),
        quality.future_date("1999-06-30"),
        quality.in_domain("facility", YARDS),
    ]
    return quality.messages(quality.check(rows, checks))


def _file_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The uploads written as CSV files, some lines with a cell too many, read back and checked."""
    target = cleaned(spark, work_folder(spark, "uploads"))
    rows = star_schema.upload_rows(spark, folder)
    names = [c for c in rows.columns if c != "row_num"]
    cells = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in names])
    lines = F.when(F.col("row_num") % 199 == 0, F.concat(cells, F.lit(",extra"))).otherwise(cells)
    # One column named by the header line, with a separator that no cell holds.
    writer = rows.select(lines.alias(",".join(names))).write.option("header", True).option("sep", "\x01")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    read = files.read_upload(spark, target)
    return quality.summary(quality.check(read, [*quality.standard_checks(), quality.malformed_line()]))


def _carrier_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Upload rows whose carrier is spelled as no carrier of the carriers table."""
    carriers_table = _tables(spark, folder).carriers
    rows = quality.with_reference(star_schema.upload_rows(spark, folder), "carrier", carriers_table, "carrier_name")
    return quality.messages(quality.check(rows, [quality.in_reference("carrier", "the carriers table")]))


def _text_folder(spark: SparkSession, folder: str) -> tuple[str, DataFrame, list[str]]:
    """The uploads as CSV lines without a header: a facility in seven is quoted and goes over two
    lines, one in five has an accent."""
    rows = star_schema.upload_rows(spark, folder)
    names = [c for c in rows.columns if c != "row_num"]
    accent = F.when(F.col("row_num") % 5 == 0, F.concat("facility", F.lit(" é"))).otherwise(F.col("facility"))
    quoted = F.concat(F.lit('"'), accent, F.lit('\n""yard"", 2"'))
    facility = F.when(F.col("row_num") % 7 == 0, quoted).otherwise(accent)
    cells = [facility if c == "facility" else F.col(c) for c in names]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])
    return cleaned(spark, work_folder(spark, "texts")), rows.select("row_num", line.alias("value")), names


def _quoted_file(spark: SparkSession, folder: str) -> DataFrame:
    """Facilities of a file with line breaks in cells, and the lines that records take."""
    target, lines, names = _text_folder(spark, folder)
    lines.select("value").write.text(target)
    read = files.read_quoted(spark, target, names, header=False, glob="*.txt")
    return read.groupBy("facility").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("last_line") - F.col("row_num") + 1).alias("lines"),
        F.count(files.CORRUPT).alias("corrupt"),
    )


def _two_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """The same file, half of it in Windows-1252 and half in UTF-8: every cell is read as written."""
    target, lines, names = _text_folder(spark, folder)
    even = F.col("row_num") % 2 == 0
    windows = F.encode("value", "ISO-8859-1").cast("string").alias("value")
    lines.where(even).select(windows).write.text(f"{target}/windows")
    lines.where(~even).select("value").write.text(f"{target}/utf8")
    read = files.read_quoted(spark, f"{target}/*", names, header=False, glob="*.txt")
    warned = files.encoding_messages(spark, f"{target}/*", glob="*.txt").select("file", F.lit(1).alias("warned"))
    counted = read.join(warned.distinct(), "file", "left").groupBy("facility")
    return counted.agg(F.count(F.lit(1)).alias("rows"), F.count("warned").alias("rows_of_warned_files"))


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    """The upload loaded into stored shipments, twice under one load id."""
    columns = ("shipment_id", "facility", "miles", "row_num")
    history = enrich.shipment_view(_tables(spark, folder).shipments).withColumn("row_num", F.lit(0).cast("bigint"))
    upload = scoring.coerce_numbers(star_schema.upload_rows(spark, folder)).where("shipment_id IS NOT NULL")
    table = stored.KeyedTable(spark, cleaned(spark, work_folder(spark, "upserted")), "shipment_id", buckets=16)
    for rows, load_id in ((history, "history"), (upload, "upload"), (upload, "upload")):
        table.upsert(rows.select(*columns), load_id)
    return table.read()


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads, one of them sent twice."""
    target = cleaned(spark, work_folder(spark, "appended"))
    upload = star_schema.upload_rows(spark, folder).select("shipment_id", "facility")
    history = enrich.shipment_view(_tables(spark, folder).shipments).select("shipment_id", "facility")
    for rows, load_id in ((upload, "upload"), (history, "history"), (upload, "upload")):
        stored.append_once(rows, target, load_id)
    return stored.read_loads(spark, target).groupBy("load", "facility").agg(F.count(F.lit(1)).alias("rows"))


@lru_cache(maxsize=4)
def _kept_weeks(spark: SparkSession, folder: str) -> weekly.KeptWeeks:
    """Three deliveries, each with rows of every week, and one of them sent twice."""
    tables = _tables(spark, folder)
    kept = weekly.KeptWeeks(spark, cleaned(spark, work_folder(spark, "weeks")))
    for n in (0, 1, 2, 1):
        part = FreightTables(
            tables.shipments.where(F.pmod(F.xxhash64("ShipmentId"), F.lit(3)) == n),
            tables.charges.where(F.pmod(F.xxhash64("charge_id"), F.lit(3)) == n),
            tables.carriers,
            tables.facilities,
        )
        kept.add(part, f"delivery {n}")
    return kept


def _frame_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_schema.upload_rows(spark, folder)
    odd = rows.withColumnRenamed("miles", "Notes")
    small = quality.frame_messages(spark, rows.where("row_num <= 5"))
    return quality.frame_messages(spark, odd).unionByName(small)


def _encoding(rows: DataFrame) -> DataFrame:
    damaged = F.when(F.col("row_num") % 241 == 0, F.concat("facility", F.lit("\ufffd")))
    damaged_rows = rows.withColumn("facility", F.coalesce(damaged, "facility"))
    return quality.messages(quality.check(damaged_rows, [quality.encoding_damage("facility", "carrier")]))


def _flag_warnings(t: FreightTables) -> DataFrame:
    rows = t.shipments.withColumns({"row_num": F.lit(0), "shipment_id": F.col("ShipmentId")})
    checked = quality.check(rows, [quality.cost_without_flag("AccessorialCost", "AccessorialFlag")])
    return quality.messages(checked).select(
        "shipment_id", "rule", F.regexp_replace("message", "^Row 0: ", "").alias("message")
    )


def _tier_warnings(rows: DataFrame) -> DataFrame:
    far = scoring.coerce_numbers(rows).withColumn("risk_tier", F.when(F.col("miles") > 1200, "High"))
    return quality.messages(quality.check(far, [quality.missing_tier()])).select("row_num", "message")


def _preview_checks(spark: SparkSession, folder: str) -> DataFrame:
    shown = _preview(spark, folder).select("ShipmentId")
    known = shown.join(_tables(spark, folder).shipments.select("ShipmentId"), "ShipmentId", "left_semi")
    rows = shown.agg(F.count("*").alias("rows"))
    return rows.select("rows", known.agg(F.count("*").alias("n")).scalar().alias("in_table"))


def _quarantine(checked: DataFrame) -> DataFrame:
    held = quality.quarantined_rows(checked)
    issues = F.col(quality.ERRORS) + F.col(quality.WARNINGS)
    return held.withColumn("n_issues", issues).drop(quality.ISSUES, quality.ERRORS, quality.WARNINGS)


def _resolved(policy: str) -> Query:
    return lambda spark, folder: _merged(spark, folder, policy)


def _merged(spark: SparkSession, folder: str, policy: str) -> DataFrame:
    columns = ("shipment_id", "facility", "miles")
    stored = _tables(spark, folder).shipments
    existing = enrich.shipment_view(stored).select(*columns)
    incoming = scoring.coerce_numbers(star_schema.upload_rows(spark, folder))
    return quality.resolve_duplicates(existing, incoming.select(*columns, "row_num"), policy)


def _state_codes(t: FreightTables) -> DataFrame:
    numbered = t.carriers.withColumns(
        {"row_num": F.col("carrier_id"), "shipment_id": F.lit(None).cast("string")}
    )
    found = quality.messages(quality.check(numbered, [quality.state_code("home_state")]))
    return found.select(F.col("row_num").alias("carrier_id"), "message")


def _flags(t: FreightTables) -> DataFrame:
    fixed = quality.correct_flag(t.shipments, "AccessorialCost", "AccessorialFlag")
    return fixed.select(
        F.col("ShipmentId").alias("shipment_id"), "AccessorialFlag", "flag_was_corrected"
    )


def _tier_defaults(rows: DataFrame) -> DataFrame:
    far = scoring.coerce_numbers(rows).withColumn("risk_tier", F.when(F.col("miles") > 1200, "High"))
    return quality.default_tier(far).select("row_num", "risk_tier")


def _new_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = star_schema.upload_rows(spark, folder)
    numbers = {name: parse_number(name) for name in ("weight_lbs", "miles")}
    return rows.withColumns(numbers).select("row_num", "shipment_id", *numbers)


def _range_warnings(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return costs.range_warnings(tables, _new_features(spark, folder))


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    view = enrich.shipment_view(_tables(spark, folder).shipments)
    medians = guards.exact_medians(view, "weight_lbs", "miles")
    filled = guards.fill_missing(_new_features(spark, folder), medians)
    return filled.select("row_num", *medians, F.size("imputed").alias("n_imputed"))


def _imputation_warnings(spark: SparkSession, folder: str) -> DataFrame:
    view = enrich.shipment_view(_tables(spark, folder).shipments)
    medians = guards.exact_medians(view, "weight_lbs", "miles")
    filled = guards.fill_missing(_new_features(spark, folder), medians)
    return guards.imputation_warnings(filled, "row_num")


@lru_cache(maxsize=4)
def _pages(spark: SparkSession, folder: str) -> ranges.PageIndex:
    """One index for all pages of a session and folder."""
    return shipments.page_index(_tables(spark, folder))


@lru_cache(maxsize=4)
def _fitted(spark: SparkSession, folder: str) -> cost_model.CostModel:
    """One forest for all queries of a session and folder."""
    return costs.fit(_tables(spark, folder))


def _estimates(spark: SparkSession, folder: str) -> DataFrame:
    return costs.estimates(_tables(spark, folder), _fitted(spark, folder), each_tree=False)


def _estimate_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can say of the estimates: all shipments, bounds in order, plain comparisons."""
    found = _estimates(spark, folder)
    in_order = (F.col("lower") >= 0) & (F.col("lower") <= F.col("estimate")) & (
        F.col("estimate") <= F.col("upper")
    )
    return found.select(
        "shipment_id",
        F.size("imputed").alias("n_imputed"),
        in_order.alias("in_order"),
        half_even("simple_estimate", 4).alias("simple_estimate"),
        "fleet_average",
    )


def _importance(spark: SparkSession, folder: str) -> DataFrame:
    return cost_model.feature_importance(_fitted(spark, folder), 12)


def _importance_checks(spark: SparkSession, folder: str) -> DataFrame:
    """All features, largest first, adding up to one."""
    found = cost_model.feature_importance(_fitted(spark, folder))
    listed = found.agg(F.collect_list("importance").alias("all"))
    drops = F.transform(
        "all", lambda x, i: F.coalesce(x >= F.get(F.col("all"), i + 1), F.lit(True))
    )
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x)
    return listed.select(
        F.size("all").cast("bigint").alias("features"),
        F.forall(drops, lambda x: x).alias("sorted_down"),
        half_even(total, 4).alias("whole"),
    )


def queries() -> dict[str, Query]:
    lists = {
        "enriched_shipments": _on_tables(shipments.named_shipments),
        "charge_lines": _on_tables(
            lambda t: enrich.charge_lines(t.charges, t.shipments, t.carriers)
        ),
        "latest_shipments": _on_tables(shipments.latest_shipments),
        "latest_charges": _on_tables(accessorials.latest_charges),
        "latest_charge_lines": _on_tables(accessorials.latest_charge_lines),
        "carriers_by_name": _on_tables(lambda t: t.carriers.orderBy("carrier_name")),
        "facilities_by_name": _on_tables(lambda t: t.facilities.orderBy("facility_name")),
        "filtered_shipments": _on_tables(lambda t: shipments.shipment_list(t, LISTED)),
        "matched_counts": _on_tables(lambda t: shipments.matched_counts(t, CHOSEN)),
        "search_shipments": _on_tables(lambda t: shipments.search(t, "shp-0+1[0-9]*7$")),
        "search_shipments_literal": _on_tables(
            lambda t: shipments.search(t, "p-0000", mode="literal")
        ),
        "shipment_lookup": _on_tables(lambda t: shipments.lookup(t, "SHP-0000042")),
        "shipment_page": _on_tables(lambda t: shipments.page(t, 3)),
        "deep_page": lambda spark, folder: _pages(spark, folder).page(400),
        "next_page": _on_tables(lambda t: shipments.page_after(t, "SHP-0000074")),
        "shipments_by_weight": _on_tables(_by_weight),
        "filter_options": _on_tables(shipments.filter_options),
        "date_labels": _on_tables(
            lambda t: enrich.shipment_view(t.shipments).select(
                "shipment_id", us_date("ship_date").alias("shown")
            )
        ),
        "cost_per_mile_total_basis": _on_tables(_total_basis),
        "preview_labels": _on_tables(_lane_labels),
        "fallback_source": _on_tables(_fallback),
        # Any 500 rows: no SQL can name them.
        "table_preview": _preview,
        "preview_checks": _preview_checks,
    }
    pages = {
        "ops_kpis": _on_tables(overview.operations_kpis),
        "ops_weekly": _on_tables(overview.weekly_operations),
        "ops_weekly_filtered": _on_tables(lambda t: overview.weekly_operations(t, CHOSEN)),
        "week_over_week": _on_tables(overview.week_over_week),
        "kept_weekly": lambda spark, folder: _kept_weeks(spark, folder).weekly_operations(),
        "kept_week_over_week": lambda spark, folder: _kept_weeks(spark, folder).week_over_week(),
        "kept_charges_weekly": lambda spark, folder: _kept_weeks(spark, folder).weekly_charges(),
        "cpm_by_carrier": _on_tables(overview.cost_per_mile_by_carrier),
        "cost_breakdown_by_carrier": _on_tables(overview.cost_breakdown_by_carrier),
        "risk_kpis": _on_tables(overview.risk_kpis),
        "risk_kpis_delta": _on_tables(lambda t: overview.risk_kpis_delta(t, CHOSEN)),
        "risk_kpis_delta_nothing": _on_tables(lambda t: overview.risk_kpis_delta(t, NOBODY)),
        "risk_histogram": _on_tables(overview.risk_histogram),
        "risk_by_carrier": _on_tables(overview.risk_by_carrier),
        "risk_by_carrier_top8": _on_tables(lambda t: overview.risk_by_carrier(t, top=8)),
        "lane_metrics": _on_tables(routes.route_metrics),
        "origin_metrics": _on_tables(lambda t: routes.route_metrics(t, "origin_city")),
        "destination_metrics": _on_tables(lambda t: routes.route_metrics(t, "destination_city")),
        "lane_extremes": _on_tables(routes.route_extremes),
        "lane_extremes_none": _on_tables(
            lambda t: routes.route_extremes(t, min_shipments=10**12)
        ),
        "lane_points": _on_tables(routes.route_points),
        "lanes_dearest8": _on_tables(routes.dearest),
        "lanes_cheapest8": _on_tables(routes.cheapest),
        "lane_breakdown": _on_tables(routes.breakdown),
        "carrier_metrics": _on_tables(carriers.carrier_metrics),
        "carrier_metrics_some": _on_tables(
            lambda t: carriers.carrier_metrics(t, ["Supplier#000000002", "Supplier#000000003"])
        ),
        "carrier_metrics_none": _on_tables(lambda t: carriers.carrier_metrics(t, [])),
        "carrier_summary": _on_tables(carriers.carrier_summary),
        "carriers_by_cpm": _on_tables(lambda t: carriers.carrier_ranking(t, "avg_cpm")),
        "carriers_by_high_risk": _on_tables(lambda t: carriers.carrier_ranking(t, "high_risk_pct")),
        "carriers_by_accessorial_rate": _on_tables(
            lambda t: carriers.carrier_ranking(t, "accessorial_rate")
        ),
        "carrier_radar": _on_tables(carriers.carrier_radar),
        "accessorial_kpis": _on_tables(accessorials.accessorial_kpis),
        "accessorial_kpis_filtered": _on_tables(
            lambda t: accessorials.accessorial_kpis(t, LINES_CHOSEN)
        ),
        "accessorial_kpis_nothing": _on_tables(
            lambda t: accessorials.accessorial_kpis(t, NO_LINES)
        ),
        "accessorial_kpis_once": _on_tables(
            lambda t: accessorials.accessorial_kpis(t, grain="shipment")
        ),
        "charges_by_type": _on_tables(accessorials.charges_by_type),
        "charges_by_type_filtered": _on_tables(
            lambda t: accessorials.charges_by_type(t, LINES_CHOSEN)
        ),
        "charges_by_carrier": _on_tables(accessorials.charges_by_carrier),
        "charges_by_carrier_filtered": _on_tables(
            lambda t: accessorials.charges_by_carrier(t, LINES_CHOSEN)
        ),
        "charges_by_facility": _on_tables(accessorials.charges_by_facility),
        "charges_weekly": _on_tables(accessorials.weekly_charges),
        "charges_weekly_filtered": _on_tables(
            lambda t: accessorials.weekly_charges(t, LINES_CHOSEN)
        ),
        "tier_outcomes": _on_tables(accessorials.tier_outcomes),
        "top15_charges": _on_tables(accessorials.top_charge_lines),
        "similar_shipments": _on_tables(shipments.similar),
        "similar_shipments_facility": _on_tables(
            lambda t: shipments.similar(t, same_facility=True)
        ),
        "similar_to_one": _on_tables(
            lambda t: ranking.similar_to(shipments.named_shipments(t), "Supplier#000000003")
        ),
        "risk_factors": _on_tables(lambda t: shipments.risk_factors(t, *WATCHED)),
        "recommended_actions": _on_tables(shipments.recommended_actions),
    }
    uploads = {
        "upload_messages": _on_checked(quality.messages),
        "upload_messages_strict": _on_uploads(_strict_messages),
        "upload_summary": _on_checked(quality.summary),
        "upload_file_summary": _file_summary,
        "upload_first_errors": _on_uploads(quality.first_messages),
        "upload_preview": _on_uploads(quality.first_rows),
        "upload_clean_rows": _on_checked(quality.clean_rows),
        "upload_quarantine": _on_checked(_quarantine),
        "duplicate_ids": _on_uploads(quality.duplicate_ids),
        "duplicate_rows": _on_uploads(quality.duplicate_rows),
        "duplicates_skipped": _on_uploads(quality.keep_one),
        "duplicates_updated": _resolved("update"),
        "duplicates_kept": _resolved("skip"),
        "upload_frame_messages": _frame_messages,
        "carrier_reference_messages": _carrier_reference,
        "quoted_file": _quoted_file,
        "two_encodings": _two_encodings,
        "upserted_shipments": _upserted,
        "appended_loads": _appended,
        "encoding_messages": _on_uploads(_encoding),
        "flag_warnings": _on_tables(_flag_warnings),
        "tier_warnings": _on_uploads(_tier_warnings),
        "carrier_near_duplicates": _on_uploads(quality.near_duplicates),
        "carriers_unified": _on_uploads(
            lambda rows: quality.unify_spelling(rows).select("row_num", "carrier")
        ),
        "rule_score": _on_uploads(
            lambda rows: scoring.score(rows).select(
                "row_num", "shipment_id", "risk_score", "risk_tier"
            )
        ),
        "numbers_coerced": _on_uploads(
            lambda rows: scoring.coerce_numbers(rows).select("row_num", *scoring.NUMERIC)
        ),
        "flag_corrected": _on_tables(_flags),
        "state_code_errors": _on_tables(_state_codes),
        "orphan_carriers": _on_tables(lambda t: quality.orphan_carriers(t.shipments, t.carriers)),
        "carriers_completed": _on_tables(
            lambda t: quality.complete_carriers(t.shipments, t.carriers)
        ),
        "tier_defaults": _on_uploads(_tier_defaults),
    }
    estimates = {
        "fleet_baselines": _on_tables(costs.fleet_baselines),
        "cost_histogram": _on_tables(costs.cost_histogram),
        "estimate_position": _on_tables(
            lambda t: costs.estimate_position(t, list(oracle.ESTIMATES))
        ),
        "freight_positions": _on_tables(costs.freight_positions),
        "model_guards": _on_tables(costs.model_guards),
        "class_weights": _on_tables(costs.class_weights),
        "range_warnings": _range_warnings,
        "missing_features_filled": _filled,
        "imputation_warnings": _imputation_warnings,
        "estimate_checks": _estimate_checks,
        "importance_checks": _importance_checks,
        # A random forest has no SQL counterpart: these two are checked by their properties.
        "cost_predictions": _estimates,
        "feature_importance": _importance,
    }
    found = {**lists, **pages, **uploads, **estimates}
    if llm:
        found |= llm.queries()
    if llm and corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle.queries()
    return found | llm.oracle_sql() if llm else found
