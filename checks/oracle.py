"""The registered queries once more, as plain SQL for DuckDB over the same Parquet tables.

Written from the semantics, independently of the Spark operators; only the adapter that
derives the freight tables from the star schema is shared text.
"""

from __future__ import annotations

from haulscope.sources import star_schema

_TABLES = {
    "shipments": star_schema.SHIPMENTS_SQL,
    "charges": star_schema.CHARGES_SQL,
    "carriers": star_schema.CARRIERS_SQL,
    "facilities": star_schema.FACILITIES_SQL,
    "uploads": star_schema.UPLOADS_SQL,
}

_S = """
SELECT sh.ShipmentId AS shipment_id, sh.ShipDate AS ship_date, c.carrier_name AS carrier,
  sh.FacilityType AS facility, sh.weight_lbs, sh.DistanceMiles AS miles,
  sh.LinehaulCost AS base_freight_usd, sh.AccessorialCost AS accessorial_charge_usd,
  sh.OriginRegion, sh.DestRegion, sh.Revenue, sh.AccessorialFlag, sh.risk_score, sh.risk_tier,
  sh.AppointmentType, sh.LinehaulCost + sh.AccessorialCost AS total_cost_usd,
  coalesce(sh.LinehaulCost / nullif(sh.DistanceMiles, 0), 0) AS cost_per_mile,
  coalesce(sh.OriginRegion, '?') || ' → ' || coalesce(sh.DestRegion, '?') AS lane,
  sh.OriginRegion AS origin_city, sh.DestRegion AS destination_city
FROM shipments sh LEFT JOIN carriers c ON sh.CarrierId = c.carrier_id
"""

_L = """
SELECT ch.charge_id, ch.shipment_id, ch.charge_type AS accessorial_type,
  ch.amount AS accessorial_charge_usd, ch.risk_flag, ch.invoice_date AS ship_date, ch.disputed,
  sh.FacilityType AS facility, sh.LinehaulCost AS base_freight_usd, sh.risk_score, sh.risk_tier,
  c.carrier_name AS carrier, coalesce(sh.LinehaulCost, 0) + coalesce(ch.amount, 0) AS total_cost_usd
FROM charges ch LEFT JOIN shipments sh ON ch.shipment_id = sh.ShipmentId
LEFT JOIN carriers c ON sh.CarrierId = c.carrier_id
"""

# Uploads as a file reader delivers them: a missing-value text is no value.
_CELLS = """
SELECT * REPLACE (CASE WHEN accessorial_charge_usd <> 'n/a' THEN accessorial_charge_usd END
  AS accessorial_charge_usd) FROM uploads
"""


def _over(sql: str, *names: str) -> str:
    """``sql`` behind the CTEs it names (``s`` and ``l`` bring the tables they read)."""
    wanted = list(names)
    if "l" in names or "s" in names:
        wanted = [*(("charges",) if "l" in names else ()), "shipments", "carriers", *wanted]
    texts = {**{k: star_schema.portable_sql(v) for k, v in _TABLES.items()}}
    texts |= {"s": _S, "l": _L, "cells": _CELLS}
    ctes = ",\n".join(f"{n} AS ({texts[n]})" for n in dict.fromkeys(wanted))
    sql = sql.strip()
    if sql.startswith("WITH "):
        return f"WITH {ctes},\n{sql[len('WITH '):]}"
    return f"WITH {ctes}\n{sql}"


def _sum(column: str, where: str | None = None) -> str:
    money = f"sum(CAST({column} AS DECIMAL(18,2)))"
    if where:
        money += f" FILTER (WHERE {where})"
    return f"CAST(coalesce({money}, 0) AS DOUBLE)"


def _avg_money(column: str, where: str | None = None) -> str:
    cond = f" FILTER (WHERE {where})" if where else ""
    return (
        f"CAST(sum(CAST({column} AS DECIMAL(18,2))){cond} AS DOUBLE)"
        f" / nullif(count({column}){cond}, 0)"
    )


def _avg(column: str) -> str:
    return f"round_even(avg({column}), 6)"


def _pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100, {digits})"


# --- lists ----------------------------------------------------------------------------------

_LIST = """shipment_id, ship_date, carrier, facility, weight_lbs, miles, risk_score, risk_tier,
  base_freight_usd, accessorial_charge_usd"""
_FULL = _LIST + """, OriginRegion, DestRegion, Revenue, AccessorialFlag, AppointmentType,
  total_cost_usd, cost_per_mile, lane, origin_city, destination_city"""

CHOSEN = """ship_date >= TIMESTAMP '1996-01-01' AND ship_date <= TIMESTAMP '1998-12-31'
  AND risk_tier IN ('High', 'Medium')
  AND carrier IN ('Supplier#000000001', 'Supplier#000000004', 'Supplier#000000007')"""


def _lists() -> dict[str, str]:
    return {
        "enriched_shipments": _over(f"SELECT {_FULL} FROM s", "s"),
        "charge_lines": _over("SELECT * FROM l", "l"),
        "latest_shipments": _over(
            f"SELECT {_FULL} FROM s ORDER BY ship_date DESC NULLS LAST, shipment_id LIMIT 1000", "s"
        ),
        "latest_charges": _over(
            "SELECT * FROM charges ORDER BY invoice_date DESC NULLS LAST, charge_id, amount,"
            " charge_type, risk_flag LIMIT 2000",
            "charges",
        ),
        "latest_charge_lines": _over(
            "SELECT * FROM l ORDER BY ship_date DESC NULLS LAST, charge_id, accessorial_charge_usd,"
            " accessorial_type, risk_flag LIMIT 2000",
            "l",
        ),
        "carriers_by_name": _over("SELECT * FROM carriers ORDER BY carrier_name", "carriers"),
        "facilities_by_name": _over("SELECT * FROM facilities ORDER BY facility_name", "facilities"),
        "filtered_shipments": _over(
            f"SELECT {_LIST} FROM s WHERE {CHOSEN} AND facility IN ('BUILDING', 'MACHINERY')", "s"
        ),
        "matched_counts": _over(
            f"SELECT count(*) FILTER (WHERE {CHOSEN}) AS shown, count(*) AS total FROM s", "s"
        ),
        "search_shipments": _over(
            f"SELECT {_LIST} FROM s WHERE regexp_matches(shipment_id, 'SHP-0+1[0-9]*7$')", "s"
        ),
        "search_shipments_literal": _over(
            f"SELECT {_LIST} FROM s WHERE contains(shipment_id, 'P-0000')", "s"
        ),
        "shipment_lookup": _over(
            f"SELECT {_LIST}, lane, total_cost_usd FROM s WHERE shipment_id = 'SHP-0000042'", "s"
        ),
        "shipment_page": _over(f"SELECT {_LIST} FROM s ORDER BY shipment_id LIMIT 25 OFFSET 50", "s"),
        "deep_page": _over(
            f"""WITH n AS (SELECT count(*) AS total FROM s)
            SELECT {_LIST}, row_number() OVER (ORDER BY shipment_id) + 9975 AS place,
              CAST(9976 AS BIGINT) AS first_row, CAST(10000 AS BIGINT) AS last_row, total AS total_rows
            FROM (SELECT {_LIST} FROM s ORDER BY shipment_id LIMIT 25 OFFSET 9975) CROSS JOIN n""",
            "s",
        ),
        "next_page": _over(
            f"SELECT {_LIST} FROM s WHERE shipment_id > 'SHP-0000074' ORDER BY shipment_id LIMIT 25", "s"
        ),
        "shipments_by_weight": _over(
            f"SELECT {_LIST} FROM s ORDER BY weight_lbs DESC, shipment_id", "s"
        ),
        "filter_options": _over(
            """SELECT DISTINCT 'carrier' AS field, carrier AS option FROM s WHERE carrier IS NOT NULL
            UNION ALL SELECT DISTINCT 'facility', facility FROM s WHERE facility IS NOT NULL
            UNION ALL SELECT DISTINCT 'accessorial_type', charge_type FROM charges
              WHERE charge_type IS NOT NULL
            UNION ALL SELECT 'min_date', strftime(min(ship_date), '%Y-%m-%d') FROM s
            UNION ALL SELECT 'max_date', strftime(max(ship_date), '%Y-%m-%d') FROM s""",
            "s", "charges",
        ),
        "date_labels": _over(
            "SELECT shipment_id, strftime(ship_date, '%m/%d/%Y') AS shown FROM s", "s"
        ),
        "cost_per_mile_total_basis": _over(
            """SELECT shipment_id, coalesce(CASE WHEN miles > 0
              THEN round_even(total_cost_usd / miles, 4) END, 0) AS cost_per_mile FROM s""",
            "s",
        ),
        "fallback_source": _over(f"SELECT {_LIST} FROM s", "s"),
        "preview_labels": _over(
            """SELECT DISTINCT CASE WHEN length(lane) <= 15 THEN lane
              ELSE substring(lane, 1, 12) || '…' END AS label, lane FROM s""",
            "s",
        ),
    }


# --- overview -------------------------------------------------------------------------------


def _overview() -> dict[str, str]:
    def deltas(cond: str) -> str:
        return f"""
        SELECT count(*) FILTER (WHERE p) AS shipments,
          CASE WHEN count(*) FILTER (WHERE p) = 0 THEN 0
            ELSE round_even(avg(risk_score) FILTER (WHERE p) * 100, 4) END AS avg_risk_pct,
          count(*) FILTER (WHERE p AND risk_tier = 'High') AS high_risk,
          {_sum("accessorial_charge_usd", "p")} AS accessorial_cost,
          count(*) FILTER (WHERE p) - count(*) AS shipments_delta,
          CASE WHEN count(*) FILTER (WHERE p) = 0 THEN 0 ELSE
            round_even((avg(risk_score) FILTER (WHERE p)) * 100 - avg(risk_score) * 100, 4)
          END AS avg_risk_pct_delta,
          count(*) FILTER (WHERE p AND risk_tier = 'High')
            - count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_delta,
          CAST(coalesce(sum(CAST(accessorial_charge_usd AS DECIMAL(18,2))) FILTER (WHERE p), 0)
            - coalesce(sum(CAST(accessorial_charge_usd AS DECIMAL(18,2))), 0) AS DOUBLE)
            AS accessorial_cost_delta
        FROM (SELECT *, coalesce({cond}, false) AS p FROM s)"""

    brackets = " UNION ALL ".join(
        f"SELECT {i} AS bracket, '{i * 10}–{i * 10 + 10}%' AS label, "
        f"{'-1e0' if i == 0 else f'{i}e-1'} AS lo, {i + 1}e-1 AS hi"
        for i in range(10)
    )
    return {
        "ops_kpis": _over(
            f"""SELECT count(*) AS shipments, {_sum("base_freight_usd")} AS revenue,
              {_sum("total_cost_usd")} AS total_cost, {_sum("accessorial_charge_usd")} AS accessorial_cost,
              {_avg("cost_per_mile")} AS avg_cpm,
              {_pct("count(*) FILTER (WHERE accessorial_charge_usd > 0)", "count(*)")} AS accessorial_rate
            FROM s""",
            "s",
        ),
        "ops_weekly": _over(
            f"""SELECT date_trunc('week', ship_date)::TIMESTAMP AS week, count(shipment_id) AS shipments,
              {_sum("base_freight_usd")} AS revenue, {_sum("total_cost_usd")} AS total_cost
            FROM s WHERE ship_date IS NOT NULL GROUP BY 1""",
            "s",
        ),
        "ops_weekly_filtered": _over(
            f"""SELECT date_trunc('week', ship_date)::TIMESTAMP AS week, count(shipment_id) AS shipments,
              {_sum("base_freight_usd")} AS revenue, {_sum("total_cost_usd")} AS total_cost
            FROM s WHERE {CHOSEN} GROUP BY 1""",
            "s",
        ),
        "week_over_week": _over(
            f"""WITH w AS (
              SELECT date_trunc('week', ship_date)::TIMESTAMP AS week, count(*) AS shipments,
                round_even(round_even(sum(risk_score), 6) / count(risk_score) * 100, 4) AS avg_risk_pct,
                count(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
                {_sum("accessorial_charge_usd")} AS accessorial_cost
              FROM s WHERE ship_date IS NOT NULL GROUP BY 1)
            SELECT *, {", ".join(
                f"""CASE WHEN lag(week) OVER (ORDER BY week) = week - INTERVAL 7 DAY THEN
                  round_even(CAST({k} - lag({k}) OVER (ORDER BY week) AS DOUBLE), 4) END AS {k}_change"""
                for k in ("shipments", "avg_risk_pct", "high_risk", "accessorial_cost"))}
            FROM w""",
            "s",
        ),
        "cpm_by_carrier": _over(
            f"""SELECT carrier, {_avg("cost_per_mile")} AS cost_per_mile FROM s
            WHERE carrier IS NOT NULL GROUP BY carrier""",
            "s",
        ),
        "cost_breakdown_by_carrier": _over(
            f"""SELECT carrier, {_sum("base_freight_usd")} AS base, {_sum("accessorial_charge_usd")} AS acc
            FROM s WHERE carrier IS NOT NULL GROUP BY carrier""",
            "s",
        ),
        "risk_kpis": _over(
            f"""SELECT count(*) AS shipments, round_even(round_even(avg(risk_score), 6) * 100, 4) AS avg_risk_pct,
              count(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
              {_sum("accessorial_charge_usd")} AS accessorial_cost FROM s""",
            "s",
        ),
        "risk_kpis_delta": _over(deltas(CHOSEN), "s"),
        "risk_kpis_delta_nothing": _over(deltas("carrier IN ('no such carrier')"), "s"),
        "risk_histogram": _over(
            f"""SELECT b.bracket, b.label, count(s.risk_score) AS count,
              CASE WHEN b.bracket * 10 >= 67 THEN 'high' WHEN b.bracket * 10 >= 34 THEN 'medium'
                ELSE 'low' END AS band
            FROM ({brackets}) b LEFT JOIN s ON s.risk_score > b.lo AND s.risk_score <= b.hi
              AND s.risk_score >= 0
            GROUP BY 1, 2, 4""",
            "s",
        ),
        "risk_by_carrier": _over(
            f"""SELECT carrier, {_avg("risk_score")} AS risk_score,
              round_even({_avg("risk_score")} * 100, 1) AS risk_pct
            FROM s WHERE carrier IS NOT NULL GROUP BY carrier""",
            "s",
        ),
        "risk_by_carrier_top8": _over(
            f"""SELECT carrier, {_avg("risk_score")} AS risk_score,
              round_even({_avg("risk_score")} * 100, 1) AS risk_pct
            FROM s WHERE carrier IS NOT NULL GROUP BY carrier
            ORDER BY 2 DESC NULLS LAST, carrier LIMIT 8""",
            "s",
        ),
    }


# --- routes ---------------------------------------------------------------------------------


def _route(key: str, least: int = 2) -> str:
    return f"""
    SELECT *, {_pct("accessorial_cost", "total_cost")} AS accessorial_rate,
      {_pct("high_risk_count", "shipments")} AS high_risk_pct
    FROM (SELECT {key}, count(shipment_id) AS shipments, {_avg_money("total_cost_usd")} AS avg_cost,
        {_sum("total_cost_usd")} AS total_cost, {_avg("cost_per_mile")} AS avg_cpm,
        {_avg("miles")} AS avg_miles, {_avg("risk_score")} AS avg_risk,
        {_sum("accessorial_charge_usd")} AS accessorial_cost,
        count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_count
      FROM s WHERE {key} IS NOT NULL GROUP BY {key})
    WHERE shipments >= {least}"""


def _routes() -> dict[str, str]:
    lanes = _route("lane")

    def top(direction: str) -> str:
        return f"""SELECT lane, CASE WHEN length(lane) <= 28 THEN lane
            ELSE substring(lane, 1, 25) || '…' END AS label, avg_cpm
          FROM ({lanes}) ORDER BY avg_cpm {direction} NULLS LAST, lane LIMIT 8"""

    def label(name: str) -> str:
        return f"CASE WHEN length({name}) < 30 THEN {name} ELSE substring({name}, 1, 27) || '…' END"

    def extremes(rows: str, key: str) -> str:
        return f"""WITH m AS ({rows}), x AS (SELECT count(*) AS groups,
            coalesce((SELECT {key} FROM m ORDER BY shipments DESC, {key} LIMIT 1), '—') AS busiest,
            coalesce((SELECT {key} FROM m ORDER BY avg_cpm, {key} LIMIT 1), '—') AS cheapest,
            coalesce((SELECT {key} FROM m ORDER BY avg_cpm DESC, {key} LIMIT 1), '—') AS dearest FROM m)
          SELECT *, {label("busiest")} AS busiest_label, {label("cheapest")} AS cheapest_label,
            {label("dearest")} AS dearest_label FROM x"""

    return {
        "lane_metrics": _over(lanes, "s"),
        "origin_metrics": _over(_route("origin_city"), "s"),
        "destination_metrics": _over(_route("destination_city"), "s"),
        "lane_extremes": _over(extremes(lanes, "lane"), "s"),
        "lane_extremes_none": _over(extremes(_route("lane", 10**12), "lane"), "s"),
        "lane_points": _over(
            f"SELECT lane, shipments, avg_cost, total_cost, avg_risk, avg_cpm, accessorial_rate FROM ({lanes})",
            "s",
        ),
        "lanes_dearest8": _over(top("DESC"), "s"),
        "lanes_cheapest8": _over(top("ASC"), "s"),
        "lane_breakdown": _over(
            f"""SELECT lane, shipments, round_even(avg_cost, 2) AS avg_cost,
              round_even(avg_cpm, 3) AS avg_cpm, CAST(round_even(avg_miles, 0) AS INTEGER) AS avg_miles,
              round_even(avg_risk, 3) AS avg_risk, accessorial_rate, high_risk_pct, total_cost
            FROM ({lanes})""",
            "s",
        ),
    }


# --- carriers -------------------------------------------------------------------------------

_CARRIERS = f"""
SELECT *, {_pct("high_risk_count", "shipments")} AS high_risk_pct,
  {_pct("total_accessorial", "total_spend")} AS accessorial_rate
FROM (SELECT carrier, count(shipment_id) AS shipments, {_avg_money("total_cost_usd")} AS avg_cost,
    {_sum("total_cost_usd")} AS total_spend, {_avg("cost_per_mile")} AS avg_cpm,
    {_avg("risk_score")} AS avg_risk, count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_count,
    {_sum("accessorial_charge_usd")} AS total_accessorial,
    {_avg_money("accessorial_charge_usd")} AS avg_accessorial,
    {_avg("miles")} AS avg_miles, {_avg("weight_lbs")} AS avg_weight
  FROM s WHERE carrier IS NOT NULL GROUP BY carrier)"""


def _carriers() -> dict[str, str]:
    def score(measure: str, inverted: bool, name: str) -> str:
        share = f"CAST({measure} - min({measure}) OVER () AS DOUBLE) / nullif(CAST(max({measure}) OVER () - min({measure}) OVER () AS DOUBLE), 0)"
        share = f"1 - {share}" if inverted else share
        return f"""round_even(CASE WHEN min({measure}) OVER () = max({measure}) OVER () THEN 0.5::DOUBLE
            ELSE {share} END, 6) AS {name}"""

    return {
        "carrier_metrics": _over(_CARRIERS, "s"),
        "carrier_metrics_some": _over(
            f"SELECT * FROM ({_CARRIERS}) WHERE carrier IN ('Supplier#000000002', 'Supplier#000000003')",
            "s",
        ),
        "carrier_metrics_none": _over(f"SELECT * FROM ({_CARRIERS}) WHERE false", "s"),
        "carrier_summary": _over(
            f"""SELECT carrier, shipments, round_even(avg_cost, 2) AS avg_cost,
              round_even(avg_cpm, 2) AS avg_cpm, round_even(avg_risk, 2) AS avg_risk, high_risk_pct,
              round_even(avg_accessorial, 2) AS avg_accessorial, accessorial_rate,
              round_even(total_spend, 2) AS total_spend,
              CAST(round_even(avg_miles, 0) AS INTEGER) AS avg_miles,
              CAST(round_even(avg_weight, 0) AS INTEGER) AS avg_weight FROM ({_CARRIERS})""",
            "s",
        ),
        "carriers_by_cpm": _over(f"SELECT carrier, avg_cpm FROM ({_CARRIERS})", "s"),
        "carriers_by_high_risk": _over(
            f"""SELECT carrier, high_risk_pct, CASE WHEN high_risk_pct > 40 THEN 'high'
              WHEN high_risk_pct > 25 THEN 'medium' ELSE 'low' END AS band FROM ({_CARRIERS})""",
            "s",
        ),
        "carriers_by_accessorial_rate": _over(
            f"SELECT carrier, accessorial_rate FROM ({_CARRIERS})", "s"
        ),
        "carrier_radar": _over(
            f"""SELECT carrier, {score("avg_cpm", True, "cost_score")},
              {score("avg_risk", True, "low_risk_score")},
              {score("accessorial_rate", True, "accessorial_score")},
              {score("shipments", False, "volume_score")} FROM ({_CARRIERS})""",
            "s",
        ),
    }


# --- accessorials ---------------------------------------------------------------------------

LINES_CHOSEN = """ship_date >= TIMESTAMP '1996-01-01' AND ship_date <= TIMESTAMP '1999-12-31'
  AND accessorial_type IN ('Detention', 'Layover')
  AND carrier IN ('Supplier#000000001', 'Supplier#000000004', 'Supplier#000000007')"""
_CHARGED = "accessorial_charge_usd > 0"


def _accessorials() -> dict[str, str]:
    amount = "accessorial_charge_usd"

    def kpis(where: str = "true") -> str:
        return f"""SELECT {_sum(amount)} AS total_accessorial,
          count(*) FILTER (WHERE {_CHARGED}) AS charged_rows, count(*) AS total_rows,
          coalesce({_pct(f"count(*) FILTER (WHERE {_CHARGED})", "count(*)")}, 0) AS accessorial_rate,
          coalesce({_avg_money(amount, _CHARGED)}, 0) AS avg_charge,
          coalesce(max({amount}) FILTER (WHERE {_CHARGED}), 0) AS max_charge,
          coalesce({_pct(_sum(amount), _sum("total_cost_usd"))}, 0) AS pct_of_spend
        FROM l WHERE {where}"""

    def by_type(where: str = "true") -> str:
        return f"""SELECT accessorial_type, {_sum(amount)} AS total, count({amount}) AS count,
          {_pct(f"sum(CAST({amount} AS DECIMAL(18,2)))", f"sum(sum(CAST({amount} AS DECIMAL(18,2)))) OVER ()")} AS share_pct
        FROM l WHERE {_CHARGED} AND accessorial_type IS NOT NULL AND {where} GROUP BY 1"""

    def by(key: str, where: str = "true") -> str:
        return f"""SELECT {key}, {_sum(amount)} AS total, count({amount}) AS count,
          {_avg_money(amount)} AS avg
        FROM l WHERE {_CHARGED} AND {key} IS NOT NULL AND {where} GROUP BY 1"""

    def weekly(where: str = "true") -> str:
        return f"""SELECT date_trunc('week', ship_date)::TIMESTAMP AS week, {_sum(amount)} AS total
        FROM l WHERE {_CHARGED} AND ship_date IS NOT NULL AND {where} GROUP BY 1"""

    return {
        "accessorial_kpis": _over(kpis(), "l"),
        "accessorial_kpis_filtered": _over(kpis(LINES_CHOSEN), "l"),
        "accessorial_kpis_nothing": _over(kpis("accessorial_type = 'no such type'"), "l"),
        "accessorial_kpis_once": _over(
            f"""WITH p AS (SELECT shipment_id, any_value(base_freight_usd) AS base,
                sum(CAST({amount} AS DECIMAL(18,2))) AS acc FROM l GROUP BY shipment_id)
            SELECT k.* EXCLUDE (pct_of_spend), round_even(total_accessorial / (
                SELECT CAST(sum(coalesce(CAST(base AS DECIMAL(18,2)), 0) + coalesce(acc, 0)) AS DOUBLE) FROM p)
                * 100, 1) AS pct_of_spend FROM ({kpis()}) k""",
            "l",
        ),
        "charges_by_type": _over(by_type(), "l"),
        "charges_by_type_filtered": _over(by_type(LINES_CHOSEN), "l"),
        "charges_by_carrier": _over(by("carrier"), "l"),
        "charges_by_carrier_filtered": _over(by("carrier", LINES_CHOSEN), "l"),
        "charges_by_facility": _over(by("facility"), "l"),
        "charges_weekly": _over(weekly(), "l"),
        "charges_weekly_filtered": _over(weekly(LINES_CHOSEN), "l"),
        "tier_outcomes": _over(
            f"""SELECT risk_tier, count(shipment_id) AS count, {_avg_money(amount)} AS avg_acc,
              {_sum(amount)} AS total_acc,
              {_pct(f"count(*) FILTER (WHERE {_CHARGED})", "count(*)", 4)} AS pct_with_acc,
              {_avg_money("base_freight_usd")} AS avg_base, {_avg_money("total_cost_usd")} AS avg_total
            FROM l WHERE risk_tier IS NOT NULL GROUP BY 1""",
            "l",
        ),
        "top15_charges": _over(
            f"""SELECT charge_id, shipment_id, ship_date, carrier, facility, accessorial_type, {amount},
              base_freight_usd, total_cost_usd, risk_tier
            FROM l WHERE {_CHARGED}
            ORDER BY {amount} DESC, charge_id, ship_date, accessorial_type LIMIT 15""",
            "l",
        ),
    }


# --- shipment detail ------------------------------------------------------------------------


def _detail() -> dict[str, str]:
    def similar(*groups: str) -> str:
        keys = ", ".join(("carrier", *groups))
        known = " AND ".join(f"{g} IS NOT NULL" for g in ("carrier", *groups))
        return f"""SELECT * FROM (
          SELECT carrier, shipment_id, ship_date, facility, risk_score, risk_tier, accessorial_charge_usd,
            row_number() OVER (PARTITION BY {keys} ORDER BY ship_date DESC NULLS LAST, shipment_id) AS place
          FROM s WHERE {known}) WHERE place <= 10"""

    def capped(value: str, cap: str) -> str:
        return f"CASE WHEN {value} IS NOT NULL THEN least({value}, {cap}) END"

    weights = [
        ("Carrier History", "3e-1 + CASE WHEN carrier IN ('Supplier#000000003', 'Supplier#000000008') THEN 1e-1 ELSE -5e-2 END"),
        ("Facility Profile", "25e-2 + CASE WHEN contains(facility, 'MACHIN') OR contains(facility, 'HOUSE') THEN 1e-1 ELSE -5e-2 END"),
        ("Miles / Distance", f"({capped('miles / 5e3', '1e0')}) * 2e-1"),
        ("Shipment Weight", f"({capped('weight_lbs / 44e3', '1e0')}) * 15e-2"),
        ("Base Freight Rate", capped("base_freight_usd / 5e3 * 1e-1", "1e-1")),
    ]
    factors = " UNION ALL ".join(
        f"SELECT shipment_id, {i} AS pos, '{name}' AS factor, round_even({weight}, 2) AS weight FROM s"
        for i, (name, weight) in enumerate(weights)
    )
    money = lambda factor: f"'$' || format('{{:,}}', CAST(round_even(accessorial_charge_usd * {factor}, 0) AS BIGINT))"
    shown = lambda factor: f"coalesce({money(factor)}, '$nan')"
    advice = {
        "High": [
            "'Consider an alternative carrier with a lower historical detention rate for this lane.'",
            "'Request an early morning appointment window (before 10:00 AM) to reduce wait time risk.'",
            f"'Add an accessorial buffer of ' || {shown('8e-1')} || ' – ' || {shown('12e-1')} || ' to your quote.'",
            "'Confirm facility appointment and ensure dock availability before dispatch.'",
        ],
        "Medium": [
            "'Monitor appointment confirmation — delays increase detention likelihood.'",
            f"'Consider a ' || {shown('5e-1')} || ' – ' || {shown('1e0')} || ' contingency buffer in your pricing.'",
            "'Verify carrier''s recent performance on similar lanes.'",
        ],
        "Low": [
            "'Low risk profile — standard operating procedure applies.'",
            "'No additional accessorial buffer needed for this load.'",
        ],
    }
    actions = " UNION ALL ".join(
        f"SELECT shipment_id, risk_tier, {step} AS step, {text} AS action FROM s WHERE risk_tier = '{tier}'"
        for tier, texts in advice.items()
        for step, text in enumerate(texts, 1)
    )
    return {
        "similar_shipments": _over(similar(), "s"),
        "similar_shipments_facility": _over(similar("facility"), "s"),
        "similar_to_one": _over(
            """SELECT shipment_id, ship_date, facility, risk_score, risk_tier, accessorial_charge_usd
            FROM s WHERE carrier = 'Supplier#000000003'
            ORDER BY ship_date DESC NULLS LAST, shipment_id LIMIT 10""",
            "s",
        ),
        "risk_factors": _over(
            f"""WITH f AS ({factors}),
              w AS (SELECT shipment_id, CASE WHEN count(weight) = 5 THEN
                list_sum(list(weight ORDER BY weight DESC NULLS LAST, pos)) END AS whole
                FROM f GROUP BY shipment_id)
            SELECT f.shipment_id, row_number() OVER (PARTITION BY f.shipment_id
                ORDER BY weight DESC NULLS LAST, pos) AS factor_rank, factor, weight,
              round_even(weight / CASE WHEN whole = 0 THEN 1 ELSE whole END * 100, 4) AS share_pct
            FROM f JOIN w ON f.shipment_id = w.shipment_id""",
            "s",
        ),
        "recommended_actions": _over(actions, "s"),
    }


# --- uploads --------------------------------------------------------------------------------

_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _blank(column: str) -> str:
    return f"coalesce(trim({column}), '') = ''"


def _missing(column: str) -> str:
    return f"coalesce({column}, '') = ''"


_DATE = "try_strptime(trim({}), ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%m/%d/%Y'])"
_SHIP_DATE = _DATE.format("ship_date")


def _number(column: str) -> str:
    return f"CASE WHEN regexp_matches(trim({column}), {_NUMBER}) THEN TRY_CAST(trim({column}) AS DOUBLE) END"


def _issue_rows(extra: list[tuple[str, str, str, str]] = ()) -> str:
    """One SELECT per check: (severity, rule, failed, message after the row number)."""
    checks = [
        ("error", f"{c}_missing", _blank(c), f"'''{c}'' is empty or missing.'")
        for c in ("shipment_id", "carrier", "facility")
    ]
    checks.append(
        (
            "error", "ship_date_invalid",
            f"NOT ({_missing('ship_date')}) AND {_SHIP_DATE} IS NULL",
            "'''ship_date'' value ''' || ship_date || ''' is not a valid date.'",
        )
    )
    for c, top in (("weight_lbs", 200000), ("miles", 5000)):
        n = _number(c)
        shown = f"coalesce(format('{{:,}}', CAST(round_even({n}, 0) AS BIGINT)), 'nan')"
        checks.append(
            (
                "error", f"{c}_range", f"{_missing(c)} OR NOT ({n} BETWEEN 0 AND {top})",
                f"'''{c}'' value ' || {shown} || ' is out of range (0–{top:,}).'",
            )
        )
        checks.append(
            ("error", f"{c}_not_number", f"NOT ({_missing(c)}) AND ({n}) IS NULL", f"'''{c}'' is not a number.'")
        )
    for c in ("base_freight_usd", "accessorial_charge_usd"):
        n = _number(c)
        checks.append(("error", f"{c}_negative", f"({n}) < 0", f"'''{c}'' cannot be negative.'"))
        checks.append(
            ("error", f"{c}_not_number", f"NOT ({_missing(c)}) AND ({n}) IS NULL", f"'''{c}'' is not a number.'")
        )
    checks.append(
        (
            "warning", "accessorial_charge_usd_blank", _blank("accessorial_charge_usd"),
            "'''accessorial_charge_usd'' is blank — defaulted to 0.'",
        )
    )
    checks.extend(extra)
    return " UNION ALL ".join(
        f"""SELECT row_num, shipment_id, {i} AS check_no, '{severity}' AS severity, '{rule}' AS rule,
          'Row ' || CAST(row_num AS VARCHAR) || ': ' || {message} AS message
        FROM uploads WHERE {failed}"""
        for i, (severity, rule, failed, message) in enumerate(checks)
    )


_STRICT = [
    ("error", "ship_date_missing", _blank("ship_date"), "'''ship_date'' is empty or missing.'"),
    ("error", "miles_not_positive", f"({_number('miles')}) <= 0", "'Distance must be greater than 0'"),
    (
        "warning", "miles_long", f"({_number('miles')}) > 5000",
        f"'Distance of ' || CAST(CAST(round_even({_number('miles')}, 0) AS BIGINT) AS VARCHAR)"
        " || ' miles exceeds typical US range. Verify accuracy.'",
    ),
    (
        "warning", "ship_date_future",
        f"{_SHIP_DATE} > TIMESTAMP '1999-06-30'",
        "'Future date detected. Use only historical data for training.'",
    ),
    (
        "error", "facility_unknown",
        f"NOT ({_blank('facility')}) AND facility NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
        "'''facility'' value ''' || facility || ''' is not one of: BUILDING, MACHINERY, FURNITURE.'",
    ),
]


def _uploads() -> dict[str, str]:
    rows = _issue_rows()
    position = "row_number() OVER (PARTITION BY row_num ORDER BY check_no) - 1 AS position"
    positioned = f"SELECT row_num, shipment_id, {position}, severity, rule, message FROM ({{}})"
    # A NULL facility stays an empty cell, quoted or not.
    accent = "CASE WHEN row_num % 5 = 0 THEN facility || ' é' ELSE facility END"
    written = f"""CASE WHEN row_num % 7 = 0 THEN {accent} || chr(10) || '"yard", 2' ELSE {accent} END"""
    extra = "CASE WHEN row_num % 7 = 0 AND facility IS NOT NULL THEN 1 ELSE 0 END"
    summary = f"""WITH m AS ({rows}), t AS (SELECT (SELECT count(*) FROM uploads) AS n,
        (SELECT count(*) FROM m WHERE severity = 'error') AS e,
        (SELECT count(*) FROM m WHERE severity = 'warning') AS w,
        (SELECT count(DISTINCT row_num) FROM m WHERE severity = 'error') AS bad)
      SELECT n AS rows, e AS errors, w AS warnings, n - e AS rows_passed_ref,
        n - bad AS rows_without_error, e = 0 AS may_score FROM t"""
    malformed = [("error", "malformed_line", "row_num % 199 = 0", "'line could not be parsed.'")]
    file_summary = summary.replace(rows, _issue_rows(malformed)).replace("FROM uploads", "FROM cells")
    first = f"""WITH m AS ({positioned.format(rows)}), e AS (SELECT * FROM m WHERE severity = 'error')
      SELECT row_num, rule, message, greatest((SELECT count(*) FROM e) - 50, 0) AS more
      FROM e ORDER BY row_num, position LIMIT 50"""
    bad_rows = f"SELECT row_num FROM ({rows}) WHERE severity = 'error'"
    repeated = f"""SELECT shipment_id, count(*) AS occurrences, min(row_num) AS first_row,
        max(row_num) AS last_row FROM uploads WHERE NOT ({_blank("shipment_id")})
        GROUP BY shipment_id HAVING count(*) > 1"""
    spell = f"""WITH c AS (SELECT carrier AS spelling, count(*) AS rows, lower(trim(carrier)) AS normal
        FROM uploads WHERE NOT ({_blank("carrier")}) GROUP BY carrier),
      p AS (SELECT *, count(*) OVER (PARTITION BY normal) AS variants,
        first_value(spelling) OVER (PARTITION BY normal ORDER BY rows DESC, spelling) AS canonical FROM c)"""
    num0 = lambda c: f"coalesce({_number(c)}, 0)"
    score = (
        f"round_even(least(greatest({num0('weight_lbs')} / 44e3 * 3e-1 + {num0('miles')} / 5e3 * 4e-1, 5e-2), 98e-2), 3)"
    )
    return {
        "upload_messages": _over(positioned.format(rows), "uploads"),
        "upload_messages_strict": _over(positioned.format(_issue_rows(_STRICT)), "uploads"),
        "upload_summary": _over(summary, "uploads"),
        "upload_file_summary": _over(file_summary, "uploads", "cells"),
        "upload_first_errors": _over(first, "uploads"),
        "upload_preview": _over("SELECT * FROM uploads ORDER BY row_num LIMIT 25", "uploads"),
        "upload_clean_rows": _over(
            f"SELECT * FROM uploads WHERE row_num NOT IN ({bad_rows})", "uploads"
        ),
        "upload_quarantine": _over(
            f"""SELECT u.*, m.n_issues FROM uploads u JOIN (SELECT row_num, count(*) AS n_issues
              FROM ({rows}) GROUP BY row_num) m ON m.row_num = u.row_num
            WHERE u.row_num IN ({bad_rows})""",
            "uploads",
        ),
        "duplicate_ids": _over(repeated, "uploads"),
        "duplicate_rows": _over(
            f"SELECT u.*, d.occurrences FROM uploads u JOIN ({repeated}) d ON d.shipment_id = u.shipment_id",
            "uploads",
        ),
        "duplicates_skipped": _over(
            f"""SELECT u.* FROM uploads u LEFT JOIN ({repeated}) d ON d.shipment_id = u.shipment_id
            WHERE d.first_row IS NULL OR d.first_row = u.row_num""",
            "uploads",
        ),
        "upserted_shipments": _over(
            f"""WITH d AS ({repeated}), good AS (SELECT u.shipment_id, facility,
                {num0("miles")} AS miles, u.row_num FROM uploads u LEFT JOIN d ON d.shipment_id = u.shipment_id
                WHERE u.shipment_id IS NOT NULL AND (d.last_row IS NULL OR d.last_row = u.row_num))
            SELECT shipment_id, facility, miles FROM good
            UNION ALL SELECT ShipmentId, FacilityType, DistanceMiles FROM shipments
              WHERE ShipmentId NOT IN (SELECT shipment_id FROM good)""",
            "uploads", "shipments",
        ),
        "appended_loads": _over(
            """SELECT 'upload' AS load, facility, count(*) AS rows FROM uploads GROUP BY facility
            UNION ALL SELECT 'history', FacilityType, count(*) FROM shipments GROUP BY FacilityType""",
            "uploads", "shipments",
        ),
        "carrier_reference_messages": _over(
            f"""SELECT row_num, shipment_id, 0 AS position, 'error' AS severity, 'carrier_unknown' AS rule,
              'Row ' || row_num || ': ''carrier'' value ''' || carrier || ''' is not in the carriers table.' AS message
            FROM uploads WHERE NOT ({_blank("carrier")})
              AND carrier NOT IN (SELECT carrier_name FROM carriers WHERE carrier_name IS NOT NULL)""",
            "uploads", "carriers",
        ),
        "quoted_file": _over(
            f"""SELECT {written} AS facility, count(*) AS rows, sum({extra} + 1)::BIGINT AS lines,
              CAST(0 AS BIGINT) AS corrupt FROM uploads GROUP BY 1""",
            "uploads",
        ),
        "two_encodings": _over(
            f"""SELECT {written} AS facility, count(*) AS rows,
              count(*) FILTER (WHERE row_num % 2 = 0) AS rows_of_warned_files FROM uploads GROUP BY 1""",
            "uploads",
        ),
        "duplicates_updated": _over(
            f"""WITH d AS ({repeated}), good AS (SELECT u.shipment_id, facility,
                {num0("miles")} AS miles FROM uploads u LEFT JOIN d ON d.shipment_id = u.shipment_id
                WHERE d.last_row IS NULL OR d.last_row = u.row_num)
            SELECT * FROM good
            UNION ALL SELECT ShipmentId, FacilityType, DistanceMiles FROM shipments
              WHERE ShipmentId NOT IN (SELECT shipment_id FROM good WHERE shipment_id IS NOT NULL)""",
            "uploads", "shipments",
        ),
        "duplicates_kept": _over(
            f"""WITH d AS ({repeated}), good AS (SELECT u.shipment_id, facility,
                {num0("miles")} AS miles FROM uploads u LEFT JOIN d ON d.shipment_id = u.shipment_id
                WHERE d.first_row IS NULL OR d.first_row = u.row_num)
            SELECT ShipmentId AS shipment_id, FacilityType AS facility, DistanceMiles AS miles FROM shipments
            UNION ALL SELECT * FROM good WHERE shipment_id IS NULL
              OR shipment_id NOT IN (SELECT ShipmentId FROM shipments)""",
            "uploads", "shipments",
        ),
        "upload_frame_messages": _over(
            """SELECT 'error' AS severity, 'missing_columns' AS rule,
              'Missing required column(s): miles' AS message FROM uploads HAVING count(*) > 0
            UNION ALL SELECT 'warning', 'extra_columns', 'Column(s) will be ignored: Notes'
              FROM uploads HAVING count(*) > 0
            UNION ALL SELECT 'warning', 'small_file',
              'Please upload a file with at least 10 shipment records.'
              FROM uploads WHERE row_num <= 5 HAVING count(*) BETWEEN 1 AND 9""",
            "uploads",
        ),
        "encoding_messages": _over(
            """SELECT row_num, shipment_id, 0 AS position, 'warning' AS severity, 'encoding' AS rule,
              'Row ' || CAST(row_num AS VARCHAR)
                || ': Special characters detected - ensure file is UTF-8 encoded' AS message
            FROM uploads WHERE row_num % 241 = 0 AND facility IS NOT NULL""",
            "uploads",
        ),
        "flag_warnings": _over(
            """SELECT ShipmentId AS shipment_id, 'flag_corrected' AS rule,
              'Cost present but flag is ''No''. Auto-correcting flag to ''Yes''.' AS message
            FROM shipments WHERE AccessorialCost > 0 AND AccessorialFlag = 0""",
            "shipments",
        ),
        "tier_warnings": _over(
            f"""SELECT row_num, 'Row ' || CAST(row_num AS VARCHAR)
              || ': ''risk_tier'' defaulted to ''Low''' AS message
            FROM uploads WHERE coalesce({_number("miles")}, 0) <= 1200""",
            "uploads",
        ),
        "carrier_near_duplicates": _over(
            f"SELECT * FROM ({spell} SELECT spelling, rows, normal, variants, canonical FROM p WHERE variants > 1)",
            "uploads",
        ),
        "carriers_unified": _over(
            f"""SELECT u.row_num, coalesce(x.canonical, u.carrier) AS carrier FROM uploads u
            LEFT JOIN ({spell} SELECT spelling, canonical FROM p) x ON x.spelling = u.carrier""",
            "uploads",
        ),
        "rule_score": _over(
            f"""SELECT row_num, shipment_id, risk_score, CASE WHEN risk_score >= 67e-2 THEN 'High'
              WHEN risk_score >= 34e-2 THEN 'Medium' ELSE 'Low' END AS risk_tier
            FROM (SELECT row_num, shipment_id, {score} AS risk_score FROM uploads)""",
            "uploads",
        ),
        "numbers_coerced": _over(
            f"""SELECT row_num, {num0("weight_lbs")} AS weight_lbs, {num0("miles")} AS miles,
              {num0("base_freight_usd")} AS base_freight_usd FROM uploads""",
            "uploads",
        ),
        "flag_corrected": _over(
            """SELECT ShipmentId AS shipment_id, CASE WHEN AccessorialCost > 0 THEN 1 ELSE AccessorialFlag END
              AS AccessorialFlag, coalesce(AccessorialCost > 0 AND AccessorialFlag = 0, false)
              AS flag_was_corrected FROM shipments""",
            "shipments",
        ),
        "state_code_errors": _over(
            """SELECT carrier_id, 'Row ' || CAST(carrier_id AS VARCHAR) || ': Invalid state code '''
              || home_state || '''. Use 2-letter abbreviation.' AS message
            FROM carriers WHERE home_state NOT IN ('TX', 'CA', 'AR')""",
            "carriers",
        ),
        "orphan_carriers": _over(
            """SELECT CarrierId AS carrier_id, count(*) AS shipments FROM shipments
            WHERE CarrierId IS NOT NULL AND CarrierId NOT IN (SELECT carrier_id FROM carriers) GROUP BY 1""",
            "shipments", "carriers",
        ),
        "carriers_completed": _over(
            """SELECT * FROM carriers UNION ALL
            SELECT DISTINCT CarrierId, NULL, NULL, NULL, NULL, NULL::INTEGER, NULL FROM shipments
            WHERE CarrierId IS NOT NULL AND CarrierId NOT IN (SELECT carrier_id FROM carriers)""",
            "shipments", "carriers",
        ),
        "tier_defaults": _over(
            f"""SELECT row_num, CASE WHEN {_number("miles")} > 1200 THEN 'High' ELSE 'Low' END AS risk_tier
            FROM uploads""",
            "uploads",
        ),
    }


# --- cost estimate --------------------------------------------------------------------------

ESTIMATES = (500.0, 1500.0, 2000.0, 2500.0, 4000.0)


def _costs() -> dict[str, str]:
    picks = ", ".join(f"({e}::DOUBLE)" for e in ESTIMATES)
    guards = """WITH per AS (SELECT CarrierId AS who, count(*) AS n FROM shipments GROUP BY 1),
      f AS (SELECT (SELECT count(*) FROM shipments) AS rows,
        (SELECT count(*) FROM shipments WHERE AccessorialFlag = 1) AS yes,
        (SELECT count(*) FROM shipments WHERE AccessorialFlag = 0) AS no,
        (SELECT max(n) FROM per WHERE who IS NOT NULL) AS top_rows)
      SELECT 'too_few_rows' AS rule, 'error' AS severity, rows < 100 AS triggered, NULL::DOUBLE AS share,
        CASE WHEN rows < 100 THEN 'Minimum 100 historical records required. Current: ' || rows || '.' END AS message
      FROM f
      UNION ALL SELECT 'one_outcome', 'error', yes = 0 OR no = 0, NULL, NULL FROM f
      UNION ALL SELECT 'class_imbalance', 'warning', greatest(yes, no)::DOUBLE / (yes + no) >= 98e-2,
        round_even(greatest(yes, no)::DOUBLE / (yes + no), 6), NULL FROM f
      UNION ALL SELECT 'carrier_dominance', 'warning', top_rows::DOUBLE / rows >= 95e-2,
        round_even(top_rows::DOUBLE / rows, 6), NULL FROM f"""
    whole = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
    feature = lambda f, title: f"""
      SELECT shipment_id, '{f}' AS feature, {f} AS value,
        CASE WHEN {f} > hi THEN hi ELSE lo END AS limit_value,
        '{title} ' || {whole(f)} || CASE WHEN {f} > hi
            THEN ' exceeds training maximum of ' || {whole("hi")}
            ELSE ' is below training minimum of ' || {whole("lo")} END
          || '. Prediction reliability reduced.' AS message
      FROM new, (SELECT min({f}) AS lo, max({f}) AS hi FROM s) WHERE {f} > hi OR {f} < lo"""
    new = f"""SELECT row_num, shipment_id, {_number("weight_lbs")} AS weight_lbs, {_number("miles")} AS miles
      FROM uploads"""
    return {
        "fleet_baselines": _over(
            f"SELECT {_avg('cost_per_mile')} AS avg_cpm, {_avg_money('total_cost_usd')} AS avg_total FROM s",
            "s",
        ),
        "cost_histogram": _over(
            """WITH k AS (SELECT total_cost_usd AS c FROM s WHERE total_cost_usd IS NOT NULL),
              r AS (SELECT min(c) AS lo, max(c) AS hi, (max(c) - min(c)) / 30e0 AS w FROM k),
              n AS (SELECT CAST(least(coalesce(floor((c - lo) / nullif(w, 0)), 0), 29) AS INTEGER) AS bin,
                count(*) AS found FROM k, r GROUP BY 1)
            SELECT CAST(b.bin AS INTEGER) AS bin, round_even(lo + b.bin * w, 4) AS low_edge,
              round_even(lo + (b.bin + 1) * w, 4) AS high_edge, coalesce(found, 0) AS count
            FROM range(30) b(bin) CROSS JOIN r LEFT JOIN n ON n.bin = b.bin WHERE lo IS NOT NULL""",
            "s",
        ),
        "estimate_position": _over(
            f"""SELECT estimate, count(*) FILTER (WHERE total_cost_usd <= estimate) AS below,
              count(*) AS history,
              {_pct("count(*) FILTER (WHERE total_cost_usd <= estimate)", "count(*)", 4)} AS percentile
            FROM (VALUES {picks}) e(estimate), s WHERE total_cost_usd IS NOT NULL GROUP BY estimate""",
            "s",
        ),
        "freight_positions": _over(
            f"""WITH k AS (SELECT total_cost_usd AS c, count(*) AS n FROM s
                WHERE total_cost_usd IS NOT NULL GROUP BY 1),
              r AS (SELECT c, sum(n) OVER (ORDER BY c) AS upto FROM k)
            SELECT shipment_id, base_freight_usd AS estimate,
              CAST(CASE WHEN base_freight_usd IS NOT NULL THEN coalesce(upto, 0) END AS BIGINT) AS below,
              CAST((SELECT sum(n) FROM k) AS BIGINT) AS history,
              {_pct("CASE WHEN base_freight_usd IS NOT NULL THEN coalesce(upto, 0) END", "(SELECT sum(n) FROM k)", 4)} AS percentile
            FROM s ASOF LEFT JOIN r ON s.base_freight_usd >= r.c""",
            "s",
        ),
        "model_guards": _over(guards, "shipments"),
        "class_weights": _over(
            """SELECT AccessorialFlag, count(*) AS rows,
              round_even((SELECT count(*) FROM shipments)::DOUBLE / ((SELECT count(DISTINCT AccessorialFlag)
                FROM shipments) * count(*))::DOUBLE, 6) AS weight FROM shipments GROUP BY 1""",
            "shipments",
        ),
        "range_warnings": _over(
            f"""WITH new AS ({new}) SELECT shipment_id, feature, value, limit_value AS "limit", message
            FROM ({feature("weight_lbs", "Weight")} UNION ALL {feature("miles", "Distance")})""",
            "uploads", "s",
        ),
        "imputation_warnings": _over(
            f"""WITH new AS ({new}), m AS (SELECT median(weight_lbs) AS mw, median(miles) AS mm FROM s)
            SELECT row_num, 'weight_lbs' AS feature, mw AS value,
              'Weight is missing. The median of the training data is used.' AS message
            FROM new, m WHERE weight_lbs IS NULL
            UNION ALL SELECT row_num, 'miles', mm,
              'Distance is missing. The median of the training data is used.' FROM new, m WHERE miles IS NULL""",
            "uploads", "s",
        ),
        "estimate_checks": _over(
            f"""WITH b AS (SELECT {_avg('cost_per_mile')} AS cpm, {_avg_money('total_cost_usd')} AS fleet FROM s),
              t AS (SELECT median(miles) AS mm FROM s WHERE weight_lbs IS NOT NULL AND miles IS NOT NULL
                AND total_cost_usd IS NOT NULL)
            SELECT shipment_id, (CASE WHEN weight_lbs IS NULL THEN 1 ELSE 0 END)
                + (CASE WHEN miles IS NULL THEN 1 ELSE 0 END) AS n_imputed, true AS in_order,
              round_even(cpm * coalesce(miles, mm), 4) AS simple_estimate, fleet AS fleet_average
            FROM s, b, t""",
            "s",
        ),
        "importance_checks": _over(
            """SELECT count(DISTINCT carrier) + count(DISTINCT facility) + 2 AS features,
              true AS sorted_down, 1e0 AS whole
            FROM s WHERE weight_lbs IS NOT NULL AND miles IS NOT NULL AND total_cost_usd IS NOT NULL""",
            "s",
        ),
        "preview_checks": _over(
            "SELECT least(count(*), 500) AS rows, least(count(*), 500) AS in_table FROM shipments",
            "shipments",
        ),
        "missing_features_filled": _over(
            f"""WITH new AS ({new}), m AS (SELECT median(weight_lbs) AS mw, median(miles) AS mm FROM s)
            SELECT row_num, coalesce(weight_lbs, mw) AS weight_lbs, coalesce(miles, mm) AS miles,
              (CASE WHEN weight_lbs IS NULL THEN 1 ELSE 0 END) + (CASE WHEN miles IS NULL THEN 1 ELSE 0 END)
                AS n_imputed FROM new, m""",
            "uploads", "s",
        ),
    }


def queries() -> dict[str, str]:
    parts = (_lists, _overview, _routes, _carriers, _accessorials, _detail, _uploads, _costs)
    found = {name: sql.strip() for part in parts for name, sql in part().items()}
    # The same questions, asked of rollups that were stored by delivery.
    kept = {"kept_weekly": "ops_weekly", "kept_week_over_week": "week_over_week", "kept_charges_weekly": "charges_weekly"}
    return found | {name: found[of] for name, of in kept.items()}
