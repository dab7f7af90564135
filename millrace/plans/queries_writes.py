"""Write paths and streams as queries: each writes to a fresh folder of the
shared checkpoint directory and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean, tenancy
from ..operators.common import trailing_window
from ..session import ensure_checkpoint_dir, write_table
from ..sources import commits, layout, readers, registry, schemas, sinks
from ..streaming import live
from .catalog import query
from .oracle_views import AS_OF

P = ("production",)
BATCH_DAYS = 30
STORED = ["production_date", "machine_id", "units_produced", "defective_units", "downtime_min", "shift"]
TENANT_SCHEMA = schemas.T.StructType([f for f in schemas.TENANT_PRODUCTION.fields if f.name != "created_at"])


def _folder(fx, name: str) -> str:
    return f"{ensure_checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query("s7_replayed_batch", f"""
SELECT tenant_id, production_date, machine_id, units_produced, defective_units, downtime_min, shift
FROM production WHERE tenant_id IN ('PLANT_03', 'PLANT_04') AND production_date >= {AS_OF} - {BATCH_DAYS}""", P + ("tenants",))
def s7_replayed_batch(fx):
    """One tenant's batch of a month is sent twice, the other's fails
    after its files were staged and is sent again; the table holds each once."""
    table = _folder(fx, "s7-table")
    month = trailing_window(fx.recent(BATCH_DAYS), BATCH_DAYS, fx.as_of)
    for tenant in ("PLANT_03", "PLANT_04"):
        batch = month.filter(F.col("tenant_id") == tenant).select(*STORED)
        if tenant == "PLANT_04":
            commits.stage(tenancy.tag_tenant(batch, tenant), table, ["tenant_id", "production_date"])
        for _ in range(2):
            readers.add_production_data(batch, tenant, fx.tenants, table, batch_id="1")
    return commits.read(fx.spark, table, TENANT_SCHEMA)


@query("k1_archive_replayed", """
SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift FROM live_records""", ("live_records",))
def k1_archive_replayed(fx):
    """K1: live records archived twice under one run id."""
    table, rows = _folder(fx, "k1-archive"), fx.live_records.select(*STORED)
    for _ in range(2):
        commits.append(rows, table, "run-1", ["production_date"])
    return commits.read(fx.spark, table, rows.schema)


def _stream(fx):
    return live.event_stream(fx.spark, f"{fx.sf_dir}/event[s].parquet")


@query("st1_ingest_store", """
SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift FROM live_records""", ("live_records",))
def st1_ingest_store(fx):
    """ST1-ST3: the stream's store; a second run of the same checkpoint adds nothing."""
    store, checkpoint = _folder(fx, "st1-store"), _folder(fx, "st1-checkpoint")
    for _ in range(2):
        live.start_ingest(_stream(fx), store, checkpoint, available_now=True).awaitTermination()
    return fx.spark.read.parquet(store).select(*STORED)


@query("st4_live_machine_kpis", """
SELECT machine_id, SUM(units_produced) AS units_produced, SUM(defective_units) AS defective_units,
       SUM(downtime_min) AS downtime_minutes, COUNT(*) AS n_records
FROM live_records GROUP BY machine_id""", ("live_records",))
def st4_live_machine_kpis(fx):
    table = _folder(fx, "st4-machines")
    live.start_live_kpis(_stream(fx), _folder(fx, "st4-checkpoint"), table, available_now=True).awaitTermination()
    return live.live_kpi_table(fx.spark, table)


@query("st4_live_plant_kpis", """
WITH l AS (SELECT max(production_date) AS d FROM live_records),
a AS (SELECT CAST(trunc(SUM(units_produced)) AS BIGINT) AS tu, CAST(trunc(SUM(defective_units)) AS BIGINT) AS td,
             AVG(downtime_min) AS ad, SUM(downtime_min) AS st
      FROM live_records WHERE production_date >= (SELECT d FROM l) - 7)
SELECT COALESCE(tu, 0) AS total_units, COALESCE(td, 0) AS total_defects,
       ROUND(CASE WHEN tu > 0 THEN (tu - td) / tu * 100 ELSE 0.0 END, 2) AS yield_percentage,
       ROUND(CASE WHEN tu > 0 THEN td / tu * 100 ELSE 0.0 END, 2) AS defect_rate,
       ROUND(COALESCE(ad, 0.0), 2) AS avg_downtime, ROUND(COALESCE(st, 0.0), 2) AS total_downtime,
       ROUND((10080.0 - COALESCE(st, 0.0)) / 10080.0 * 100, 2) AS efficiency,
       strftime((SELECT d FROM l), '%Y-%m-%d') AS report_date
FROM a""", ("live_records",))
def st4_live_plant_kpis(fx):
    """The plant KPIs of the last seven days of the stream."""
    table = _folder(fx, "st4-plant")
    live.start_live_plant_kpis(_stream(fx), _folder(fx, "st4-checkpoint"), table, available_now=True).awaitTermination()
    return live.live_plant_kpis(fx.spark, table)


@query("w8_latest_stream", """
SELECT machine_id, ts, event_id, production_date, units_produced, defective_units, downtime_min, n_readings
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS r,
             COUNT(*) OVER (PARTITION BY machine_id) AS n_readings
      FROM (SELECT DISTINCT * FROM live_records)) WHERE r = 1""", ("live_records",))
def w8_latest_stream(fx):
    table = _folder(fx, "w8-log")
    live.start_latest_readings(_stream(fx), _folder(fx, "w8-checkpoint"), table, available_now=True).awaitTermination()
    return live.latest_readings(fx.spark, table)


@query("p9_tenant_id_length", """
SELECT tenant_id, length(tenant_id) >= 3 AS valid FROM
  (SELECT tenant_id FROM tenants UNION ALL SELECT substr(tenant_id, 1, 2) FROM tenants UNION ALL SELECT substr(tenant_id, 1, 3) FROM tenants)""",
       ("tenants",))
def p9_tenant_id_length(fx):
    t = fx.tenants.select("tenant_id")
    ids = t.unionByName(t.select(F.substring("tenant_id", 1, 2).alias("tenant_id"))).unionByName(
        t.select(F.substring("tenant_id", 1, 3).alias("tenant_id")))
    return ids.select("tenant_id", tenancy.valid_tenant_id(F.col("tenant_id")).alias("valid"))


@query("j7_stored_grants", """
WITH off AS (SELECT DISTINCT user_id, tenant_id FROM user_grants WHERE seq % 2 = 0 AND tenant_id IN ('PLANT_03', 'PLANT_07'))
SELECT g.user_id, g.tenant_id, user_name, user_email, role, off.user_id IS NULL AS is_active
FROM (SELECT * FROM user_grants QUALIFY row_number() OVER (PARTITION BY user_id, tenant_id ORDER BY seq DESC) = 1) g
LEFT JOIN off ON off.user_id = g.user_id AND off.tenant_id = g.tenant_id""", ("user_grants", "tenants"))
def j7_stored_grants(fx):
    """J7 from the stored grants: granted, some deactivated, compacted, granted
    again, which keeps their activity."""
    path, at = _folder(fx, "j7-grants"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    grants = fx.user_grants.drop("is_active").withColumn("changed_at", at)
    registry.register(grants.filter("seq % 2 = 0"), "users", path, fx.tenants)
    off = grants.filter("seq % 2 = 0 AND tenant_id IN ('PLANT_03', 'PLANT_07')").groupBy("user_id", "tenant_id").agg(
        F.max("seq").alias("seq")).withColumns({"is_active": F.lit(False), "changed_at": at})
    registry.set_active(off, "users", path)
    registry.compact(fx.spark, "users", path)
    registry.register(grants.filter("seq % 2 = 1"), "users", path, fx.tenants)
    return registry.registered(fx.spark, "users", path).drop("created_at")


def bucketed_pair(fx, buckets: int = 8):
    """(legacy rows, tenant rows, name and path of the latter): both bucketed."""
    p, name = fx.production, uuid.uuid4().hex
    legacy = layout.write_bucketed(p.filter("l_linenumber <= 4").select(*STORED), f"legacy_{name}",
                                   _folder(fx, "j3-legacy"), buckets)
    path = _folder(fx, "j3-target")
    target = layout.write_bucketed(p.filter("l_linenumber >= 4").select("tenant_id", *STORED), f"target_{name}", path, buckets)
    return legacy, target, f"target_{name}", path


@query("j3_bucketed_migration", """
WITH target AS (SELECT tenant_id, production_date, machine_id, units_produced, defective_units, downtime_min, shift
                FROM production WHERE l_linenumber >= 4),
legacy AS (SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift
           FROM production WHERE l_linenumber <= 4)
SELECT * FROM target UNION ALL
SELECT 'PLANT_03' AS tenant_id, l.* FROM legacy l WHERE NOT EXISTS (
  SELECT 1 FROM target t WHERE t.tenant_id = 'PLANT_03' AND t.production_date = l.production_date
  AND t.machine_id = l.machine_id)""", P)
def j3_bucketed_migration(fx, buckets: int = 8):
    """Legacy rows moved into the bucketed tenant table, twice; the second
    run finds nothing to add."""
    legacy, target, name, path = bucketed_pair(fx, buckets)
    for _ in range(2):
        new = tenancy.migrate_legacy(legacy, target, "PLANT_03").select("tenant_id", *STORED)
        staged = write_table(new, "j3-new")       # a table is not read and appended to at once
        target = layout.write_bucketed(staged, name, path, buckets, append=True)
    return target


@query("s4_csv_round_trip", """
SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift FROM production""", P)
def s4_csv_round_trip(fx):
    """Production written as CSV with display headers and read back."""
    path = _folder(fx, "s4-csv")
    clean.to_display(fx.production.select(*STORED)).write.option("header", True).csv(path)
    return readers.read_production_csv(fx.spark, path).select(*STORED)


_BAD_DATE = "l_linenumber = 7"


@query("s6_submitted_records", f"""
SELECT CASE WHEN {_BAD_DATE} THEN NULL ELSE production_date END AS production_date, machine_id,
       units_produced, defective_units, downtime_min, shift, NOT ({_BAD_DATE}) AS accepted
FROM production""", P)
def s6_submitted_records(fx):
    """Records submitted as JSON lines; those with a date that is none are refused."""
    path = _folder(fx, "s6-json")
    sent = sinks.records_json(fx.production, ["l_linenumber"]).select(
        F.when(F.expr(_BAD_DATE), F.regexp_replace("record", r"\d{4}-(\d\d)-(\d\d)", "31.$1.$2")).otherwise(
            F.col("record")).alias("value"))
    sent.write.text(path)
    typed, refused = readers.read_submit_records(fx.spark, path)
    cols = [*STORED, "accepted"]
    return typed.withColumn("accepted", F.lit(True)).select(*cols).unionByName(
        refused.withColumn("accepted", F.lit(False)).select(*cols))


@query("k5_insight_text", """
SELECT tenant_id, tenant_name, plant_location FROM tenants""", ("tenants",))
def k5_insight_text(fx):
    """K5: text blocks, one JSON line each, read back as they were."""
    path = _folder(fx, "k5-text")
    blocks = fx.tenants.select("tenant_id", "tenant_name", "plant_location")
    sinks.write_insight_text(blocks, path)
    return fx.spark.read.schema(blocks.schema).json(path)


@query("s8_d1_stored_tables", """
SELECT unnest(['live_production', 'machines_tenant', 'production_data_tenant', 'tenants', 'users_tenant', 'unknown']) AS name,
       unnest([true, true, true, true, true, false]) AS found, unnest([0, 0, 0, n, 0, 0]) AS n_rows,
       unnest([0, 0, 0, n, 0, 0]) AS n_default FROM (SELECT COUNT(*) AS n FROM tenants)""", ("tenants",))
def s8_d1_stored_tables(fx):
    """The five tables are created twice, the tenants stored without their
    optional columns; these take their defaults."""
    db, spark = f"d1_{uuid.uuid4().hex}", fx.spark
    spark.sql(f"CREATE DATABASE {db} LOCATION '{_folder(fx, 'd1')}'")
    for _ in range(2):
        readers.create_tables(spark, db)
    fx.tenants.select("tenant_id", "tenant_name", "plant_location").createOrReplaceTempView("d1_tenants")
    spark.sql(f"INSERT INTO {db}.tenants (tenant_id, tenant_name, plant_location) SELECT * FROM d1_tenants")
    spark.catalog.dropTempView("d1_tenants")
    default = F.expr("count_if(timezone = 'UTC' AND is_active AND config = '{}')").alias("n_default")
    none = F.lit(0).cast("long").alias("n_default")
    parts = []
    for name in [*readers.DDL, "unknown"]:
        found = readers.table_exists(spark, f"{db}.{name}")
        rows = spark.table(f"{db}.{name}") if found else spark.table(f"{db}.tenants").limit(0)
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_rows"), default if name == "tenants" else none)
                     .select(F.lit(name).alias("name"), F.lit(found).alias("found"), "n_rows", "n_default"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
