"""Adapter: a TPC-H-like star schema seen as the four freight tables.

The texts below are plain SQL that any ANSI engine reads, with ``{name}`` for the input
tables, so a checker can put the same derivation in front of its own queries.

Scale notes. The origin side is one row per supplier key 0..9 and the destination side one
row per nation, of which the schema has 25: these two are small by construction and are
broadcast. Both are grouped by their join key, which tells Catalyst that the key is unique, so
the joins disappear from plans that do not use their columns. ``customer`` joins by whatever
strategy its size calls for.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

# Columns read from each input; declaring them saves a schema-inference job per table.
INPUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
}

_MILES = "(o.o_orderkey * 37 + o.o_custkey * 101) % 2400"
_WEIGHT = "500 + (o.o_orderkey * 131 + o.o_custkey * 17) % 43501"
_RISK = "CAST(50 + (o.o_orderkey * 7 + o.o_custkey * 13) % 931 AS DOUBLE) / CAST(1000 AS DOUBLE)"

_DAY = "CAST(CAST(o.o_orderdate AS DATE) AS STRING)"


def _shipment_id(key: str) -> str:
    text = f"CAST({key} AS STRING)"
    # lpad would cut ids of more than seven digits.
    return f"'SHP-' || CASE WHEN {key} < 10000000 THEN lpad({text}, 7, '0') ELSE {text} END"


ORIGINS_SQL = """
SELECT s.s_suppkey AS origin_key, min(s.s_name) AS origin_carrier, min(r.r_name) AS origin_region
FROM {supplier} s
LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey
LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey
WHERE s.s_suppkey BETWEEN 0 AND 9
GROUP BY s.s_suppkey
"""

DESTINATIONS_SQL = """
SELECT n.n_nationkey AS dest_key, min(r.r_name) AS dest_region
FROM {nation} n LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey
GROUP BY n.n_nationkey
"""

SHIPMENTS_SQL = f"""
SELECT /*+ BROADCAST(org), BROADCAST(dst) */
  {_shipment_id("o.o_orderkey")} AS ShipmentId,
  o.o_orderdate AS ShipDate,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN -1
       ELSE o.o_custkey % 10 END AS CarrierId,
  c.c_mktsegment AS FacilityType,
  o.o_orderpriority AS AppointmentType,
  CASE WHEN o.o_orderkey % 61 <> 0 THEN CAST({_MILES} AS DOUBLE) END AS DistanceMiles,
  CAST({_WEIGHT} AS DOUBLE) AS weight_lbs,
  CAST(10000 + ({_MILES}) * 80 + ({_WEIGHT}) * 4 AS DOUBLE) / CAST(100 AS DOUBLE) AS LinehaulCost,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN CAST(0 AS DOUBLE)
       ELSE CAST(5000 + (o.o_orderkey * 7919) % 80001 AS DOUBLE) / CAST(100 AS DOUBLE)
  END AS AccessorialCost,
  CASE WHEN (o.o_orderstatus <> 'F') <> (o.o_orderkey % 41 = 0) THEN 1 ELSE 0 END
    AS AccessorialFlag,
  o.o_totalprice AS Revenue,
  {_RISK} AS risk_score,
  CASE WHEN {_RISK} >= 67e-2 THEN 'High' WHEN {_RISK} >= 34e-2 THEN 'Medium' ELSE 'Low' END
    AS risk_tier,
  CASE WHEN o.o_orderkey % 71 <> 0 THEN org.origin_region END AS OriginRegion,
  dst.dest_region AS DestRegion
FROM {{orders}} o
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
LEFT JOIN ({ORIGINS_SQL}) org ON org.origin_key = o.o_custkey % 10
LEFT JOIN ({DESTINATIONS_SQL}) dst ON dst.dest_key = c.c_nationkey
"""

CHARGES_SQL = f"""
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
    || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS charge_id,
  {_shipment_id("l_orderkey")} AS shipment_id,
  CASE WHEN l_returnflag = 'A' THEN 'Detention' WHEN l_returnflag = 'N' THEN 'Lumper Fee'
       WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Layover'
       WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Re-delivery' END AS charge_type,
  CASE WHEN l_discount = CAST(0 AS DOUBLE) THEN CAST(0 AS DOUBLE)
       ELSE CAST(5000 + CAST(floor(l_extendedprice) AS BIGINT) % 80000 AS DOUBLE)
            / CAST(100 AS DOUBLE) END AS amount,
  CASE WHEN l_quantity > CAST(40 AS DOUBLE) THEN 1 ELSE 0 END AS risk_flag,
  l_shipdate AS invoice_date,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS disputed,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS dispute_resolved,
  CAST(NULL AS STRING) AS notes
FROM {{lineitem}}
"""

CARRIERS_SQL = """
SELECT
  s.s_suppkey AS carrier_id,
  s.s_name AS carrier_name,
  'DOT' || CAST(s.s_suppkey AS STRING) AS dot_number,
  'MC' || CAST(s.s_suppkey AS STRING) AS mc_number,
  CASE WHEN s.s_acctbal < CAST(0 AS DOUBLE) THEN 'Conditional' ELSE 'Satisfactory' END
    AS safety_rating,
  CAST(10 + s.s_suppkey % 500 AS INTEGER) AS fleet_size,
  CASE s.s_nationkey % 5 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' WHEN 2 THEN 'AR'
       WHEN 3 THEN 'Texas' ELSE 'ZZ' END AS home_state
FROM {supplier} s
"""

FACILITIES_SQL = """
SELECT
  min(c_custkey) AS facility_id,
  c_mktsegment || ' yard' AS facility_name,
  CAST(NULL AS STRING) AS city,
  CAST(NULL AS STRING) AS state,
  CAST(NULL AS STRING) AS zip_code,
  CAST(count(*) % 12 AS DOUBLE) AS avg_dwell_time_hrs,
  1 AS appointment_required,
  c_mktsegment AS facility_type,
  '06:00' AS dock_hours_open,
  '18:00' AS dock_hours_close
FROM {customer}
GROUP BY c_mktsegment
"""

# Upload rows with planted faults: the first matching case of a column wins.
UPLOADS_SQL = f"""
SELECT /*+ BROADCAST(org) */
  o.o_orderkey + 2 AS row_num,
  CASE WHEN o.o_orderkey % 101 = 0 THEN NULL
       WHEN o.o_orderkey % 103 = 0 THEN {_shipment_id("(o.o_orderkey - 1)")}
       ELSE {_shipment_id("o.o_orderkey")} END AS shipment_id,
  CASE WHEN o.o_orderkey % 107 = 0 THEN '2024-13-01' WHEN o.o_orderkey % 109 = 0 THEN NULL
       WHEN o.o_orderkey % 197 = 0 THEN '  '
       WHEN o.o_orderkey % 199 = 0 THEN {_DAY} || 'T08:30:00'
       WHEN o.o_orderkey % 211 = 0 THEN replace({_DAY}, '-', '/')
       WHEN o.o_orderkey % 223 = 0 THEN CAST(CAST(substr({_DAY}, 6, 2) AS INTEGER) AS STRING) || '/'
         || CAST(CAST(substr({_DAY}, 9, 2) AS INTEGER) AS STRING) || '/' || substr({_DAY}, 1, 4)
       ELSE {_DAY} END AS ship_date,
  CASE WHEN o.o_orderkey % 113 = 0 THEN '   '
       WHEN o.o_orderkey % 19 = 0 THEN upper(org.origin_carrier)
       WHEN o.o_orderkey % 23 = 0 THEN lower(org.origin_carrier)
       ELSE org.origin_carrier END AS carrier,
  CASE WHEN o.o_orderkey % 127 <> 0 THEN c.c_mktsegment END AS facility,
  CASE WHEN o.o_orderkey % 131 = 0 THEN 'heavy' WHEN o.o_orderkey % 137 = 0 THEN '-200'
       WHEN o.o_orderkey % 139 = 0 THEN NULL WHEN o.o_orderkey % 149 = 0 THEN '200001'
       WHEN o.o_orderkey % 227 = 0 THEN '  '
       ELSE CAST({_WEIGHT} AS STRING) END AS weight_lbs,
  CASE WHEN o.o_orderkey % 151 = 0 THEN 'about 500' WHEN o.o_orderkey % 157 = 0 THEN '6500'
       WHEN o.o_orderkey % 229 = 0 THEN ' '
       ELSE CAST({_MILES} AS STRING) END AS miles,
  CASE WHEN o.o_orderkey % 163 = 0 THEN '-1.00' WHEN o.o_orderkey % 167 = 0 THEN NULL
       WHEN o.o_orderkey % 173 = 0 THEN '12d' WHEN o.o_orderkey % 179 = 0 THEN '1_000'
       WHEN o.o_orderkey % 233 = 0 THEN '   '
       ELSE CAST(CAST(o.o_totalprice AS DECIMAL(12, 2)) AS STRING) END AS base_freight_usd,
  CASE WHEN o.o_orderkey % 181 = 0 THEN '-5' WHEN o.o_orderkey % 191 = 0 THEN NULL
       WHEN o.o_orderkey % 193 = 0 THEN 'n/a' WHEN o.o_orderkey % 239 = 0 THEN '  '
       ELSE CAST(5000 + (o.o_orderkey * 7919) % 80001 AS STRING) END AS accessorial_charge_usd
FROM {{orders}} o
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
LEFT JOIN ({ORIGINS_SQL}) org ON org.origin_key = o.o_custkey % 10
"""


def _run(spark: SparkSession, sql: str, folder: str) -> DataFrame:
    used = {name: schema for name, schema in INPUTS.items() if "{" + name + "}" in sql}
    frames = {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        for name, schema in used.items()
    }
    return spark.sql(sql, **frames)


class StarSchemaTables:
    """``FreightTables`` whose members are set up when a query first asks for them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    @cached_property
    def shipments(self) -> DataFrame:
        return _run(self._spark, SHIPMENTS_SQL, self._folder)

    @cached_property
    def charges(self) -> DataFrame:
        return _run(self._spark, CHARGES_SQL, self._folder)

    @cached_property
    def carriers(self) -> DataFrame:
        return _run(self._spark, CARRIERS_SQL, self._folder)

    @cached_property
    def facilities(self) -> DataFrame:
        return _run(self._spark, FACILITIES_SQL, self._folder)


def upload_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, UPLOADS_SQL, folder)


def portable_sql(sql: str) -> str:
    """The text with the input names filled in, for an engine that has them as views."""
    return reduce(lambda text, name: text.replace("{" + name + "}", name), INPUTS, sql)
