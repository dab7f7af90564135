"""A2/A3 golden figures from the reference's test and sample data."""
import os

from pyspark.sql import functions as F

from data_sample import SAMPLE_CSV, SAMPLE_SUMS, UNIT_EXPECTED, UNIT_ROWS
from millrace.operators import kpi
from millrace.sources.readers import read_production_csv


def test_report_kpis_unit_rows(spark):
    # the reference's frame holds Python ints
    df = spark.createDataFrame(UNIT_ROWS, "d string, machine_id string, units_produced long,"
                                          " defective_units long, downtime_min long")
    row = kpi.report_kpis(df, None, "2026-01-15").first().asDict()
    for k, v in UNIT_EXPECTED.items():
        assert row[k] == v, (k, row)
    assert row["report_date"] == "2026-01-15"


def test_sample_csv_sums_and_machine_stats(spark, tmp_dir):
    path = os.path.join(tmp_dir, "production.csv")
    with open(path, "w") as f:
        f.write(SAMPLE_CSV)
    df = read_production_csv(spark, path)
    assert df.count() == 18
    s = df.agg(F.sum("units_produced").alias("u"), F.sum("defective_units").alias("d"),
               F.sum("downtime_min").alias("t")).first()
    assert (s.u, s.d, s.t) == (SAMPLE_SUMS["units"], SAMPLE_SUMS["defects"],
                               SAMPLE_SUMS["downtime"])
    ms = {r.machine_id: r for r in kpi.machine_stats(df, None).collect()}
    assert set(ms) == {"M1", "M2"}
    assert ms["M1"].units_produced + ms["M2"].units_produced == SAMPLE_SUMS["units"]
    k = kpi.report_kpis(df).first()
    assert k.total_units == 8850 and k.total_defects == 308
    assert k.yield_pct == round((8850 - 308) / 8850 * 100, 2)


def test_plant_kpis_empty_window_is_zero(spark):
    df = spark.createDataFrame([("2000-01-01", 5.0, 1.0, 2.0)],
                               "production_date string, units_produced double,"
                               " defective_units double, downtime_min double") \
              .withColumn("production_date", F.col("production_date").cast("date"))
    r = kpi.plant_kpis(df, 7, "2020-01-01").first()
    assert r.total_units == 0 and r.yield_percentage == 0.0 and r.efficiency == 100.0


def test_additional_metrics_formula(spark):
    df = spark.createDataFrame([("2020-01-01", 100.0, 0.0, 80.0)],
                               "production_date string, units_produced double,"
                               " defective_units double, downtime_min double") \
              .withColumn("production_date", F.col("production_date").cast("date"))
    r = kpi.additional_metrics(df, 7, "2020-01-01").first()
    assert r.energy_consumption_kwh == 50.0
    assert r.avg_cycle_time_min == round((7 * 1440 - 80) / 100, 2)
