"""Explicit schemas for every stored table and inbound record.

Storage uses snake_case; display names exist only in a final projection
(see ``millrace.operators.clean.to_display``).
"""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ["units_produced", "defective_units", "downtime_min"]

# Storage column -> display column used by reports and models.
DISPLAY_NAMES = {
    "production_date": "Date",
    "machine_id": "Machine ID",
    "units_produced": "Units Produced",
    "defective_units": "Defective Units",
    "downtime_min": "Downtime (minutes)",
    "shift": "Shift",
}

PRODUCTION = T.StructType([
    T.StructField("production_date", T.DateType(), False),
    T.StructField("machine_id", T.StringType(), False),
    T.StructField("units_produced", T.DoubleType(), False),
    T.StructField("defective_units", T.DoubleType(), False),
    T.StructField("downtime_min", T.DoubleType(), False),
    T.StructField("shift", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

TENANT_PRODUCTION = T.StructType(
    [T.StructField("tenant_id", T.StringType(), False)] + list(PRODUCTION.fields))

TENANTS = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("tenant_name", T.StringType(), False),
    T.StructField("plant_location", T.StringType(), True),
    T.StructField("timezone", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("config", T.StringType(), True),
])

MACHINES = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("machine_id", T.StringType(), False),
    T.StructField("machine_name", T.StringType(), True),
    T.StructField("machine_type", T.StringType(), True),
    T.StructField("capacity_units_per_hour", T.DoubleType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("installed_date", T.DateType(), True),
    T.StructField("last_maintenance_date", T.DateType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

USERS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("user_name", T.StringType(), True),
    T.StructField("user_email", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

# Inbound records. The submit record carries its date as text (typed later);
# the live device record carries a real date.
SUBMIT_RECORD = T.StructType([
    T.StructField("production_date", T.StringType(), True),
    T.StructField("machine_id", T.StringType(), True),
    T.StructField("units_produced", T.DoubleType(), True),
    T.StructField("defective_units", T.DoubleType(), True),
    T.StructField("downtime_min", T.DoubleType(), True),
    T.StructField("shift", T.StringType(), True),
])

LIVE_RECORD = T.StructType([
    T.StructField("production_date", T.DateType(), True),
    T.StructField("machine_id", T.StringType(), True),
    T.StructField("units_produced", T.DoubleType(), True),
    T.StructField("defective_units", T.DoubleType(), True),
    T.StructField("downtime_min", T.DoubleType(), True),
    T.StructField("shift", T.StringType(), True),
])

# The shipped CSV uses display headers; read it with this schema.
CSV_PRODUCTION = T.StructType([
    T.StructField("Date", T.DateType(), True),
    T.StructField("Shift", T.StringType(), True),
    T.StructField("Machine ID", T.StringType(), True),
    T.StructField("Units Produced", T.StringType(), True),
    T.StructField("Defective Units", T.StringType(), True),
    T.StructField("Downtime (minutes)", T.StringType(), True),
])

# NOT NULL columns and VARCHAR(n) limits of the stored tables.
NOT_NULL = {
    "production": ["production_date", "machine_id", "units_produced",
                   "defective_units", "downtime_min", "shift"],
    "tenants": ["tenant_id", "tenant_name"],
    "machines": ["tenant_id", "machine_id"],
    "users": ["user_id", "tenant_id"],
}
VARCHAR_LIMITS = {
    "production": {"tenant_id": 50, "machine_id": 50, "shift": 20},
    "tenants": {"tenant_id": 50, "tenant_name": 200, "plant_location": 200,
                "timezone": 50},
    "machines": {"tenant_id": 50, "machine_id": 50, "machine_name": 200,
                 "machine_type": 100},
    "users": {"user_id": 50, "tenant_id": 50, "user_name": 200,
              "user_email": 200, "role": 50},
}
