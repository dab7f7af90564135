"""Commits by batch id; the plant's live KPIs; latest readings as a stream."""
import datetime as dt
import os

from pyspark.sql import functions as F

from millrace.operators import kpi, windows
from millrace.sources import commits, readers, registry, schemas
from millrace.streaming import live

SCHEMA = schemas.T.StructType([f for f in schemas.TENANT_PRODUCTION.fields if f.name != "created_at"])
PARTS = ["tenant_id", "production_date"]


def rows(spark, tenant, n, day=1):
    return spark.createDataFrame([(tenant, dt.date(2024, 1, day), f"M{k}", 10.0 * k, 1.0, 2.0, "Morning") for k in range(n)], SCHEMA)


def test_a_batch_counts_once(spark, tmp_dir):
    table = os.path.join(tmp_dir, "table")
    assert commits.read(spark, table, SCHEMA).count() == 0
    assert commits.append(rows(spark, "a", 5), table, "b1", PARTS)
    assert not commits.append(rows(spark, "a", 5), table, "b1", PARTS)
    assert commits.append(rows(spark, "b", 3, 2), table, "b2", PARTS)
    got = commits.read(spark, table, SCHEMA)
    assert got.columns == SCHEMA.fieldNames() and got.count() == 8
    want = rows(spark, "a", 5).unionByName(rows(spark, "b", 3, 2))
    assert got.exceptAll(want).count() == 0


def test_staged_files_are_not_read(spark, tmp_dir):
    table = os.path.join(tmp_dir, "table")
    token = commits.stage(rows(spark, "a", 5), table, PARTS)
    assert commits.read(spark, table, SCHEMA).count() == 0
    # two writers of one batch id: the first commit wins, whole
    other = commits.stage(rows(spark, "a", 9), table, PARTS)
    assert commits.commit(spark, table, "b1", other)
    assert not commits.commit(spark, table, "b1", token)
    assert commits.read(spark, table, SCHEMA).count() == 9


def test_ingest_by_batch_id(spark, fx, tmp_dir):
    table = os.path.join(tmp_dir, "table")
    tenant = fx.tenants.first().tenant_id
    batch = rows(spark, "x", 4).drop("tenant_id")
    for _ in range(3):
        assert readers.add_production_data(batch, tenant, fx.tenants, table, batch_id="7")
    assert not readers.add_production_data(batch, "nobody", fx.tenants, table, batch_id="7")
    bad = batch.withColumn("shift", F.lit("x" * 30))
    assert not readers.add_production_data(bad, tenant, fx.tenants, table, batch_id="8")
    assert commits.read(spark, table, SCHEMA).groupBy("tenant_id").count().collect() == [(tenant, 4)]


def test_short_tenant_ids_are_refused(spark, tmp_dir):
    log = os.path.join(tmp_dir, "tenants")

    def change(tenant):
        return spark.createDataFrame([(tenant, "name", None, None, None, 1, dt.datetime(2024, 1, 1))],
                                     "tenant_id string, tenant_name string, plant_location string, timezone string, "
                                     "config string, seq long, changed_at timestamp_ntz")
    assert not registry.register(change("ab"), "tenants", log) and not os.path.exists(log)
    assert registry.register(change("abc"), "tenants", log)


def grant(spark, rows):
    return spark.createDataFrame([(u, "t01", n, None, r, s, dt.datetime(2024, 1, s)) for u, n, r, s in rows],
                                 "user_id string, tenant_id string, user_name string, user_email string, role string, "
                                 "seq long, changed_at timestamp_ntz")


def active(spark, user, flag, seq):
    return spark.createDataFrame([(user, "t01", flag, seq, dt.datetime(2024, 1, seq))],
                                 "user_id string, tenant_id string, is_active boolean, seq long, changed_at timestamp_ntz")


def test_snapshots_and_log_give_the_same_state(spark, tmp_dir, monkeypatch):
    tenants = spark.createDataFrame([("t01",)], "tenant_id string")
    plain, path = os.path.join(tmp_dir, "plain"), os.path.join(tmp_dir, "compacted")
    steps = [lambda p: registry.register(grant(spark, [("u1", "Ann", "admin", 1), ("u2", "Bob", None, 2)]), "users", p, tenants),
             lambda p: registry.set_active(active(spark, "u1", False, 3), "users", p),
             lambda p: registry.register(grant(spark, [("u1", None, "viewer", 5), ("u3", "Cy", "admin", 4)]), "users", p, tenants),
             lambda p: registry.set_active(active(spark, "u9", False, 6), "users", p),      # never registered
             lambda p: registry.register(grant(spark, [("u1", "late", "late", 2)]), "users", p, tenants),
             lambda p: registry.set_active(active(spark, "u2", False, 7), "users", p),
             lambda p: registry.set_active(active(spark, "u2", True, 8), "users", p)]
    for k, step in enumerate(steps):
        step(plain)
        step(path)
        if k in (1, 2, 5):
            assert registry.compact(spark, "users", path)
        if k == 3:      # dies after the snapshot, before the pointer
            before = registry._pointer(spark, path)
            with monkeypatch.context() as m:
                m.setattr(commits, "publish", lambda *a: 1 / 0)
                try:
                    registry.compact(spark, "users", path)
                except ZeroDivisionError:
                    pass
            assert registry._pointer(spark, path) == before
        assert set(registry.registered(spark, "users", path).collect()) == set(registry.registered(spark, "users", plain).collect())
    got = {r.user_id: (r.user_name, r.role, r.is_active, r.created_at.day) for r in registry.registered(spark, "users", path).collect()}
    assert got == {"u1": (None, "viewer", False, 1), "u2": ("Bob", "viewer", True, 2), "u3": ("Cy", "admin", True, 4)}


def test_one_of_two_compactions_counts(spark, tmp_dir, monkeypatch):
    tenants, path = spark.createDataFrame([("t01",)], "tenant_id string"), os.path.join(tmp_dir, "log")
    registry.register(grant(spark, [("u1", "Ann", "admin", 1)]), "users", path, tenants)
    stale = registry._pointer(spark, path)
    assert registry.compact(spark, "users", path)
    with monkeypatch.context() as m:
        m.setattr(registry, "_pointer", lambda *a: stale)
        assert not registry.compact(spark, "users", path)
    registry.register(grant(spark, [("u1", "Eve", "admin", 2)]), "users", path, tenants)
    assert [r.user_name for r in registry.registered(spark, "users", path).collect()] == ["Eve"]


# ------------------------------------------------------------ streams

EVENT = "event_id long, ts timestamp_ntz, machine_id string, production_date date, units_produced double, " \
        "defective_units double, downtime_min double, shift string"


def event(k, day, machine="m1", hour=0, down=5.0):
    ts = dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)
    return (k, ts, machine, ts.date(), 100.0 + k, 2.0, down, "Night")


def drop(spark, folder, name, events):
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(os.path.join(folder, name))


def stream(spark, folder):
    schema = spark.createDataFrame([], EVENT).schema
    return spark.readStream.schema(schema).parquet(os.path.join(folder, "*"))


def test_plant_kpis_of_the_trailing_days(spark, tmp_dir):
    land, table, check = (os.path.join(tmp_dir, x) for x in ("land", "table", "check"))

    def run():
        q = live.start_live_plant_kpis(stream(spark, land), check, table, days=3, available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return q
    batches = [[event(k, k % 4) for k in range(12)], [event(20, 3), event(21, 2)],
               [event(30, 9), event(31, 8, down=None)], [event(40, 9), event(41, 7)]]
    for i, events in enumerate(batches):      # each run is a restart of the same checkpoint
        drop(spark, land, f"f{i}", events)
        q = run()
    seen = spark.createDataFrame([e for b in batches for e in b], EVENT)
    got = live.live_plant_kpis(spark, table, 3).collect()
    assert got == kpi.plant_kpis(seen, 3, dt.date(2024, 1, 10)).collect()
    # a late row of an expired day neither counts nor comes back into the state
    drop(spark, land, "late", [event(50, 1), event(51, 9)])
    q = run()
    state = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert state[-1] <= 4
    logged = spark.read.parquet(table)
    assert logged.filter("batch_id > 3 AND production_date < '2024-01-05'").count() == 0


def test_latest_readings_out_of_order_and_repeated(spark, tmp_dir):
    land, table, check = (os.path.join(tmp_dir, x) for x in ("land", "table", "check"))
    first = [event(1, 0, hour=5), event(2, 0, "m2", 5), event(3, 0, hour=3)]
    second = [event(1, 0, hour=5), event(4, 0, hour=4), event(5, 0, "m2", 6), event(5, 0, "m2", 6)]
    for i, events in enumerate((first, second)):
        drop(spark, land, f"f{i}", events)
        live.start_latest_readings(stream(spark, land), check, table, watermark="1 day", available_now=True).awaitTermination(120)
    distinct = spark.createDataFrame(first + second, EVENT).dropDuplicates(["event_id"])
    want = windows.latest_reading(distinct, ["machine_id"], ["ts", "event_id"], live.READING).join(
        distinct.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_readings")), "machine_id")
    got = live.latest_readings(spark, table)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    assert {r.machine_id: (r.event_id, r.n_readings) for r in got.collect()} == {"m1": (1, 3), "m2": (5, 2)}
