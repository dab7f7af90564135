"""Streaming end state = batch result; plan shapes (pruning, no Cartesian)."""
import os
import shutil

from pyspark.sql import functions as F

from conftest import SF_SMALL
from millrace.operators import kpi, tenancy
from millrace.streaming import live


def _landing(tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(land)
    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), os.path.join(land, "part-0.parquet"))
    return land


def test_ingest_stream_persists_and_publishes(spark, fx, tmp_dir):
    land = _landing(tmp_dir)
    recs = live.event_stream(spark, land)
    q = live.start_ingest(recs, os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "ck"),
                          os.path.join(tmp_dir, "pub"), available_now=True)
    q.awaitTermination(120)
    stored = spark.read.parquet(os.path.join(tmp_dir, "store"))
    assert stored.count() == fx.live_records.count()
    msgs = spark.read.text(os.path.join(tmp_dir, "pub"))
    first = msgs.select(F.get_json_object("value", "$.type").alias("t")).first().t
    assert first == "live_update" and msgs.count() == stored.count()
    # a restart with the same checkpoint re-reads nothing (offsets committed)
    q2 = live.start_ingest(live.event_stream(spark, land), os.path.join(tmp_dir, "store"),
                           os.path.join(tmp_dir, "ck"), available_now=True)
    q2.awaitTermination(120)
    assert spark.read.parquet(os.path.join(tmp_dir, "store")).count() == stored.count()


def test_live_kpis_equal_batch_machine_stats(spark, fx, tmp_dir):
    land = _landing(tmp_dir)
    q = live.start_live_kpis(live.event_stream(spark, land), os.path.join(tmp_dir, "ck2"),
                             os.path.join(tmp_dir, "kpis"), available_now=True)
    q.awaitTermination(120)
    got = live.live_kpi_table(spark, os.path.join(tmp_dir, "kpis")).drop("n_records")
    want = kpi.machine_stats(fx.live_records, None)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_replayed_batch_replaces_itself(spark, fx, tmp_dir):
    """A batch that ran but was not committed runs again with the same id."""
    store, pub = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "pub")
    run = live.persist_and_publish(store, pub)
    rows = fx.live_records.limit(50)
    run(rows, 3)
    run(rows, 3)
    run(rows, 4)
    got = spark.read.parquet(store)
    assert got.count() == 100 and spark.read.text(pub).count() == 100
    assert "production_date" in {f.split("=")[0] for f in os.listdir(store) if "=" in f}
    day = rows.first().production_date
    plan = got.filter(F.col("production_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(production_date" in plan


def test_appends_write_one_file_per_folder(spark, fx, tmp_dir):
    from millrace.sources import sinks
    path = os.path.join(tmp_dir, "tenant")
    rows = fx.recent(3).repartition(6).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sinks.append_tenant_production(rows, path)
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    folders = rows.select("tenant_id", "production_date").distinct().count()
    assert len(files) == folders and spark.read.parquet(path).count() == rows.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corporate_summary_plan(fx):
    df = tenancy.cross_tenant_summary(fx.tenants, fx.production, 7, "1998-12-01")
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "IsNotNull(n_nationkey)" in p
    # the fact side is pre-aggregated: the last join of the tree has its
    # aggregate beneath it
    assert "partial_sum" in p and p.index("Join") < p.index("partial_sum")


def test_windows_are_partitioned(fx):
    from millrace.operators import windows
    from millrace.sources.fixtures import ORDER_COLS
    df = windows.trailing_means(fx.production.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "production_date",
        "machine_id", "downtime_min"), ["machine_id"], ORDER_COLS, {"ma": "downtime_min"}, 3)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    for line in p.splitlines():
        if "Window [" in line:
            assert "machine_id" in line, line


def test_bucketed_rows_are_joined_and_windowed_as_they_lie(spark, fx):
    from pyspark.sql import Window
    from millrace.plans.queries_writes import bucketed_pair
    legacy, target, _, _ = bucketed_pair(fx, 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = tenancy.migrate_legacy(legacy, target, "PLANT_03")
        assert "SortMergeJoin" in _plan(moved) and "Exchange" not in _plan(moved)
        plain = tenancy.migrate_legacy(legacy.repartition(3), target.repartition(3), "PLANT_03")
        assert "Exchange hashpartitioning" in _plan(plain)
        assert sorted(map(str, moved.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    w = Window.partitionBy("machine_id", "production_date").orderBy("units_produced")
    assert "Exchange" not in _plan(target.withColumn("r", F.row_number().over(w)))
    # a dimension by tenant is broadcast: the fact side keeps its place
    joined = _plan(target.join(F.broadcast(fx.tenants.select("tenant_id", "tenant_name")), "tenant_id"))
    assert "hashpartitioning(tenant_id" not in joined and "BroadcastHashJoin" in joined
