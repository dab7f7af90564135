"""Cleaning properties, validation report, J3/J5-J7 idempotence, S6-S8, D1."""
import json
import os

from pyspark.sql import functions as F

from millrace.operators import clean, tenancy
from millrace.sources import readers


def test_validate_properties(fx):
    once = clean.validate(fx.production_dirty)
    bad = once.filter((F.col("defective_units") < 0) |
                      (F.col("defective_units") > F.col("units_produced")) |
                      (F.col("downtime_min") < 0) | F.col("units_produced").isNull())
    assert bad.count() == 0
    twice = clean.validate(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_validation_report_and_log(fx):
    rep = {r.rule: r.n_rows for r in clean.validation_report(fx.production_dirty).collect()}
    assert rep["missing"] > 0 and rep["negative:downtime_min"] > 0 and rep["capped"] > 0
    log = clean.validation_log_text(clean.validation_report(fx.production_dirty)).first().text
    assert log.startswith(clean.LOG_HEADER)
    assert log.index("Missing values") < log.index("Negative values") < log.index("Defects exceeded")
    ok = clean.validation_log_text(clean.validation_report(fx.production)).first().text
    assert ok == clean.MSG_OK


def test_migration_is_idempotent(fx):
    p = fx.production
    legacy = p.filter(F.col("l_linenumber") <= 4).select(*tenancy.MIGRATED_COLS[1:])
    target = p.filter(F.col("l_linenumber") >= 4)
    moved = tenancy.migrate_legacy(legacy, target, "PLANT_03")
    grown = target.select(*tenancy.MIGRATED_COLS).unionByName(moved)
    again = tenancy.migrate_legacy(legacy, grown, "PLANT_03")
    assert moved.count() > 0 and again.count() == 0


def test_upserts_idempotent_and_null_wins(spark, fx):
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    cur = fx.machines.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    inc = fx.machines.filter(F.col("machine_type") == "Press") \
                     .withColumn("machine_type", F.lit(None).cast("string"))
    once = tenancy.upsert_machines(cur, inc, now)
    twice = tenancy.upsert_machines(once, inc, now)
    assert once.exceptAll(twice).count() == 0
    assert once.count() == cur.count()
    touched = once.join(inc.select("tenant_id", "machine_id"), ["tenant_id", "machine_id"])
    assert touched.filter(F.col("machine_type").isNotNull()).count() == 0
    # user grants: re-grant keeps is_active of the stored row
    users = spark.createDataFrame([("u1", "PLANT_01", "A", "a@x", "admin", False, None)],
                                  "user_id string, tenant_id string, user_name string,"
                                  " user_email string, role string, is_active boolean,"
                                  " created_at timestamp_ntz")
    grant = spark.createDataFrame([("u1", "PLANT_01", "B", "b@x", None), ("u2", "PLANT_01", "C", "c@x", "manager")],
                                  "user_id string, tenant_id string, user_name string,"
                                  " user_email string, role string")
    out = {r.user_id: r for r in tenancy.upsert_users(users, grant, now).collect()}
    assert out["u1"].is_active is False and out["u1"].user_name == "B" and out["u1"].role == "viewer"
    assert out["u2"].is_active is True


def test_ingest_batch_all_or_nothing(spark, fx, tmp_dir):
    path = os.path.join(tmp_dir, "tenant_production")
    batch = fx.production.limit(50).select(*readers.REQUIRED)
    assert readers.add_production_data(batch, "PLANT_01", fx.tenants, path)
    assert spark.read.parquet(path).count() == 50
    assert not readers.add_production_data(batch, "PLANT_99", fx.tenants, path)
    assert spark.read.parquet(path).count() == 50
    assert readers.add_production_data(batch.limit(0), "PLANT_01", fx.tenants, path)
    # a missing column refuses the batch, as in the reference
    assert not readers.add_production_data(batch.drop("shift"), "PLANT_01", fx.tenants, path)
    assert spark.read.parquet(path).count() == 50
    t = readers.read_production(spark, path, tenant=True)
    plan = tenancy.for_tenant(t, "PLANT_01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_submit_records_reader(spark, tmp_dir):
    path = os.path.join(tmp_dir, "submit.json")
    recs = [{"production_date": "2026-01-15", "machine_id": "M1", "units_produced": 500,
             "defective_units": 10, "downtime_min": 15, "shift": "Morning"},
            {"production_date": "15/01/2026", "machine_id": "M1", "units_produced": 1,
             "defective_units": 0, "downtime_min": 0, "shift": "Night"}]
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n{not json\n")
    ok, bad = readers.read_submit_records(spark, path)
    assert ok.count() == 1 and bad.count() == 2


def test_ddl_and_exists(spark, tmp_dir):
    db = "millrace_test_ddl"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{tmp_dir}/wh'")
    names = readers.create_tables(spark, db)
    assert all(readers.table_exists(spark, n) for n in names)
    assert not readers.table_exists(spark, f"{db}.nope")
    spark.sql(f"INSERT INTO {db}.tenants (tenant_id, tenant_name) VALUES ('PLANT_01', 'x')")
    r = spark.table(f"{db}.tenants").first()
    assert r.timezone == "UTC" and r.is_active is True and r.config == "{}"


def test_registry_and_migration(spark, tmp_dir):
    import datetime as dt

    from millrace.sources import registry
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    tenants = os.path.join(tmp_dir, "tenants")
    cols = "tenant_id string, tenant_name string, plant_location string, timezone string, config string, seq int, changed_at timestamp"
    assert registry.register(spark.createDataFrame([("P_A", "one", "x", None, None, 1, t0), ("P_A", "two", None, "CET", "{}", 2, t1),
                                                    ("P_B", "b", "y", None, None, 1, t0)], cols), "tenants", tenants)
    assert not registry.register(spark.createDataFrame([("P_C", None, "x", None, None, 3, t0)], cols), "tenants", tenants)
    now = registry.registered(spark, "tenants", tenants)
    rows = {r.tenant_id: r for r in now.collect()}
    assert set(rows) == {"P_A", "P_B"}
    assert (rows["P_A"].tenant_name, rows["P_A"].plant_location, rows["P_A"].timezone) == ("two", None, "CET")
    assert rows["P_B"].timezone == "UTC" and rows["P_A"].created_at == t0 and rows["P_A"].updated_at == t1
    machines = os.path.join(tmp_dir, "machines")
    mcols = "tenant_id string, machine_id string, machine_name string, machine_type string, capacity_units_per_hour double, seq int, changed_at timestamp"
    good, bad = ("P_A", "m", "n", "t", None, 1, t0), ("P_Z", "m", "n", "t", 1.0, 2, t0)
    assert not registry.register(spark.createDataFrame([good, bad], mcols), "machines", machines, now)
    assert registry.register(spark.createDataFrame([good], mcols), "machines", machines, now)
    assert registry.registered(spark, "machines", machines).count() == 1

    target = os.path.join(tmp_dir, "target")
    assert registry.migrate(spark, "no_such_table", "P_A", target) and not os.path.exists(target)
    spark.createDataFrame([(dt.date(2024, 1, 1), "m", 1.0, 0.0, 0.0, "Night")] * 2 + [(dt.date(2024, 1, 2), "m", 1.0, 0.0, 0.0, None)],
                          "production_date date, machine_id string, units_produced double, defective_units double, "
                          "downtime_min double, shift string").createOrReplaceTempView("legacy_rows")
    for _ in range(2):
        assert registry.migrate(spark, "legacy_rows", "P_A", target)
        assert spark.read.parquet(target).count() == 3
    assert registry.migrate(spark, "legacy_rows", "P_B", target) and spark.read.parquet(target).count() == 6


def test_csv_columns_are_taken_by_header(spark, tmp_dir):
    import pytest
    from millrace.sources import readers
    path = os.path.join(tmp_dir, "by_header.csv")
    with open(path, "w") as f:
        f.write("Units Produced,Note,Machine ID,Date,Shift,Downtime (minutes),Defective Units\n"
                "10,x,M1,2024-01-02,Night,bad,1\n,y,M2,no date,Day,5,2\n")
    a, b = readers.read_production_csv(spark, path).orderBy("machine_id").collect()
    assert (str(a.production_date), a.shift, a.machine_id, a.units_produced, a.defective_units, a.downtime_min) == (
        "2024-01-02", "Night", "M1", 10.0, 1.0, 0.0)
    assert (b.production_date, b.units_produced, b.downtime_min) == (None, 0.0, 5.0)
    with open(path, "w") as f:
        f.write("Date,Shift\n2024-01-02,Night\n")
    with pytest.raises(Exception, match="Machine ID"):
        readers.read_production_csv(spark, path).collect()


def test_machines_that_share_an_id_are_all_upserted(spark, tmp_dir):
    import __spark_entry__ as entry
    from oracle_check import compare, duck
    rows = [(k, f"s{k}", 3, float(k % 7) - 2) for k in (1234, 12340, 12341, 12342, 12345, 7, 99990)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double") \
         .write.parquet(os.path.join(tmp_dir, "supplier.parquet"))
    con = duck(os.path.join(tmp_dir, "none"))
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_dir}/supplier.parquet/*.parquet')")
    res = compare(entry.queries()["j6_upsert_machines"](spark, tmp_dir), con, entry.oracle_sql()["j6_upsert_machines"])
    assert res["ok"] and res["rows_spark"] > len(rows), res
