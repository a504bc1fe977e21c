"""Declared schemas of the four stored tables and of the upload file.

Amounts of money have at most two decimal digits: sums are taken in whole cents. The check
``operators.quality.whole_cents`` reports amounts with more.
"""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SHIPMENTS = _schema(
    ("ShipmentId", T.StringType()),
    ("ShipDate", T.TimestampNTZType()),
    ("CarrierId", T.LongType()),
    ("FacilityType", T.StringType()),
    ("AppointmentType", T.StringType()),
    ("DistanceMiles", T.DoubleType()),
    ("weight_lbs", T.DoubleType()),
    ("LinehaulCost", T.DoubleType()),
    ("AccessorialCost", T.DoubleType()),
    ("AccessorialFlag", T.IntegerType()),
    ("Revenue", T.DoubleType()),
    ("risk_score", T.DoubleType()),
    ("risk_tier", T.StringType()),
    ("OriginRegion", T.StringType()),
    ("DestRegion", T.StringType()),
)

CHARGES = _schema(
    ("charge_id", T.StringType()),
    ("shipment_id", T.StringType()),
    ("charge_type", T.StringType()),
    ("amount", T.DoubleType()),
    ("risk_flag", T.IntegerType()),
    ("invoice_date", T.TimestampNTZType()),
    ("disputed", T.IntegerType()),
    ("dispute_resolved", T.IntegerType()),
    ("notes", T.StringType()),
)

CARRIERS = _schema(
    ("carrier_id", T.LongType()),
    ("carrier_name", T.StringType()),
    ("dot_number", T.StringType()),
    ("mc_number", T.StringType()),
    ("safety_rating", T.StringType()),
    ("fleet_size", T.IntegerType()),
    ("home_state", T.StringType()),
)

FACILITIES = _schema(
    ("facility_id", T.LongType()),
    ("facility_name", T.StringType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("zip_code", T.StringType()),
    ("avg_dwell_time_hrs", T.DoubleType()),
    ("appointment_required", T.IntegerType()),
    ("facility_type", T.StringType()),
    ("dock_hours_open", T.StringType()),
    ("dock_hours_close", T.StringType()),
)

# The columns an upload must bring, in their documented order.
UPLOAD_COLUMNS = (
    "shipment_id",
    "ship_date",
    "carrier",
    "facility",
    "weight_lbs",
    "miles",
    "base_freight_usd",
    "accessorial_charge_usd",
)

# The documented domains.
RISK_TIERS = ("Low", "Medium", "High")
CHARGE_TYPES = ("Detention", "Lumper Fee", "Layover", "Re-delivery")

# US state and district codes.
STATE_CODES = tuple(
    """AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT
    NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY""".split()
)
