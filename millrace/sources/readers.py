"""Batch readers, ingest with checks, table DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, tenancy
from ..session import write_table
from . import commits, schemas, sinks

REQUIRED = ["production_date", "machine_id", "units_produced", "defective_units",
            "downtime_min", "shift"]


def read_production(spark: SparkSession, path: str, tenant: bool = False) -> DataFrame:
    """S1/S2 the stored production table (partitioned parquet)."""
    schema = schemas.TENANT_PRODUCTION if tenant else schemas.PRODUCTION
    return spark.read.schema(schema).parquet(path)


def read_production_csv(spark: SparkSession, path: str) -> DataFrame:
    """S4 the production CSV (display headers) -> storage names, numeric measures.

    Columns are taken by their header, in any order; others are left out, a
    missing one is an error, and so are files of one folder whose headers differ.
    """
    raw = (spark.read.option("header", True).option("enforceSchema", False)
           .option("mode", "PERMISSIVE").csv(path))
    typed = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schemas.CSV_PRODUCTION.fields])
    return clean.coerce_numeric(clean.to_storage(typed))


def read_submit_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6 submitted records (JSON lines) -> (typed, rejected).

    Malformed JSON lands in ``_corrupt_record``; a date that does not parse
    as ``yyyy-MM-dd`` rejects the record too.
    """
    schema = T.StructType(list(schemas.SUBMIT_RECORD.fields)
                          + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    typed = raw.withColumn("production_date",
                           F.try_to_date(F.col("production_date"), "yyyy-MM-dd"))
    ok = F.col("_corrupt_record").isNull() & F.col("production_date").isNotNull()
    return (typed.filter(ok).drop("_corrupt_record"),
            typed.filter(~ok))


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """P7 required-column check (schema only; no job runs)."""
    return [c for c in (required or REQUIRED) if c not in df.columns]


def add_production_data(batch: DataFrame, tenant_id: str, tenants: DataFrame,
                        table_path: str, batch_id: str | None = None) -> bool:
    """S7 tenant batch ingest: all-or-nothing.

    P7 columns -> P8 tag -> J4 tenant known -> D2 constraints -> K2 append.
    A missing column refuses the batch, an empty batch is a success. The batch is
    written once before the checks, so the checks and the append read the same
    rows whatever executors are lost. With a ``batch_id`` the append is a commit
    (``commits.read`` reads the table): a batch sent again is a success and adds
    nothing.
    """
    if missing_columns(batch):
        return False
    tagged = tenancy.tag_tenant(batch.select(*REQUIRED), tenant_id)
    checked = write_table(tagged.withColumn("production_date", F.col("production_date").cast("date")), "s7-batch")
    if checked.isEmpty():
        return True
    verdict = tenancy.referential_check(checked, tenants).first()
    if not verdict["accepted"]:
        return False
    _, rejected = clean.split_by_constraints(checked, "production")
    if not rejected.isEmpty():
        return False
    if batch_id is None:
        sinks.append_tenant_production(checked, table_path)
    else:
        commits.append(checked, table_path, f"{tenant_id}-{batch_id}", ["tenant_id", "production_date"])
    return True


def table_exists(spark: SparkSession, name: str) -> bool:
    """S8 table-existence probe (a missing legacy table means nothing to do)."""
    return spark.catalog.tableExists(name)


# D1 table DDL (Spark SQL). Defaults follow the stored tables' definitions;
# NOT NULL / UNIQUE / FK are enforced at write time.
DDL = {
    "live_production": """
CREATE TABLE IF NOT EXISTS {db}.live_production (
  production_date DATE, machine_id VARCHAR(50), units_produced DOUBLE,
  defective_units DOUBLE, downtime_min DOUBLE, shift VARCHAR(20), created_at TIMESTAMP_NTZ)
USING parquet PARTITIONED BY (production_date)""",
    "production_data_tenant": """
CREATE TABLE IF NOT EXISTS {db}.production_data_tenant (
  machine_id VARCHAR(50), units_produced DOUBLE, defective_units DOUBLE,
  downtime_min DOUBLE, shift VARCHAR(20), created_at TIMESTAMP_NTZ,
  tenant_id VARCHAR(50), production_date DATE)
USING parquet PARTITIONED BY (tenant_id, production_date)""",
    "tenants": """
CREATE TABLE IF NOT EXISTS {db}.tenants (
  tenant_id VARCHAR(50), tenant_name VARCHAR(200), plant_location VARCHAR(200),
  timezone VARCHAR(50) DEFAULT 'UTC', is_active BOOLEAN DEFAULT TRUE,
  created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, config STRING DEFAULT '{{}}')
USING parquet""",
    "machines_tenant": """
CREATE TABLE IF NOT EXISTS {db}.machines_tenant (
  tenant_id VARCHAR(50), machine_id VARCHAR(50), machine_name VARCHAR(200),
  machine_type VARCHAR(100), capacity_units_per_hour DOUBLE, is_active BOOLEAN DEFAULT TRUE,
  installed_date DATE, last_maintenance_date DATE, created_at TIMESTAMP_NTZ)
USING parquet""",
    "users_tenant": """
CREATE TABLE IF NOT EXISTS {db}.users_tenant (
  user_id VARCHAR(50), tenant_id VARCHAR(50), user_name VARCHAR(200),
  user_email VARCHAR(200), role VARCHAR(50) DEFAULT 'viewer',
  is_active BOOLEAN DEFAULT TRUE, created_at TIMESTAMP_NTZ)
USING parquet""",
}


def create_tables(spark: SparkSession, database: str = "millrace") -> list[str]:
    """D1 create the five tables if absent; returns their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for ddl in DDL.values():
        spark.sql(ddl.format(db=database))
    return [f"{database}.{t}" for t in DDL]
