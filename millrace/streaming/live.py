"""Live device feed as Structured Streaming (S5, ST1-ST4).

The reference polls three devices every 5 s and appends whatever it gets.
Here the feed is a stream source (files or Kafka) with the same six-field
record; each micro-batch is persisted and published in ``foreachBatch``
(ST1/ST2). Offsets live in the checkpoint and every output is keyed by
batch id, so a replayed batch overwrites its own output instead of
duplicating it (ST3, effectively-once). ST4 keeps per-machine running KPIs
and the plant's trailing days as streaming aggregate state.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import KEEP_NULLS
from ..operators import kpi, windows
from ..operators.common import last_day, trailing_window
from ..sources.fixtures import live_from_events
from ..sources.schemas import LIVE_RECORD

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

TICK = "5 seconds"


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S5 device events from a parquet landing folder, mapped to live records."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return live_from_events(reader.parquet(path))


def record_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S5 live records already in the six-field shape (json/parquet files)."""
    return spark.readStream.schema(LIVE_RECORD).format(fmt).load(path)


def kafka_record_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """S5 the same record from a Kafka topic (value = JSON); needs the Kafka
    connector on the classpath."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.from_json(F.col("value").cast("string"), LIVE_RECORD).alias("r")) \
              .select("r.*")


def envelope(batch: DataFrame, batch_id: int) -> DataFrame:
    """ST2 published messages: JSON (type, timestamp, batch_id, data).

    One message per record, so publishing never gathers a batch into one
    task (the reference sends the whole poll as one list).
    """
    return batch.select(F.to_json(F.struct(
        F.lit("live_update").alias("type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(batch_id).alias("batch_id"),
        F.struct(F.date_format("production_date", "yyyy-MM-dd").alias("production_date"),
                 "machine_id", "units_produced", "defective_units", "downtime_min",
                 "shift").alias("data")), KEEP_NULLS).alias("value"))


def persist_and_publish(store_path: str, publish_path: str | None = None):
    """ST1/ST2/ST3 ``foreachBatch`` body: persist, then publish.

    The store is partitioned by day, then batch, so history scans prune by day;
    a batch replayed after a failure replaces its own (day, batch) folders.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("production_date", "machine_id", "units_produced",
                            "defective_units", "downtime_min", "shift")
        (rows.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "production_date")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("production_date", "batch_id").parquet(store_path))
        if publish_path:
            envelope(rows, batch_id).write.mode("overwrite") \
                .text(os.path.join(publish_path, f"batch_id={batch_id}"))
    return run


def start_ingest(records: DataFrame, store_path: str, checkpoint: str,
                 publish_path: str | None = None, available_now: bool = False,
                 tick: str = TICK) -> StreamingQuery:
    """ST1 continuous ingest on a fixed tick (``availableNow`` for tests/backfill)."""
    w = (records.writeStream.foreachBatch(persist_and_publish(store_path, publish_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=tick)
    return w.start()


def live_machine_kpis(records: DataFrame) -> DataFrame:
    """ST4 running per-machine totals (streaming aggregate state per machine)."""
    return records.groupBy("machine_id").agg(
        F.sum("units_produced").alias("units_produced"),
        F.sum("defective_units").alias("defective_units"),
        F.sum("downtime_min").alias("downtime_minutes"),
        F.count(F.lit(1)).alias("n_records"))


def windowed_machine_kpis(records: DataFrame, ts_col: str = "ts",
                          watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """ST4 bounded-state form: event-time windows closed by a watermark."""
    return (records.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window), "machine_id")
            .agg(F.sum("units_produced").alias("units_produced"),
                 F.sum("defective_units").alias("defective_units"),
                 F.sum("downtime_min").alias("downtime_minutes")))


def start_live_kpis(records: DataFrame, checkpoint: str, table_path: str,
                    available_now: bool = False, tick: str = TICK) -> StreamingQuery:
    """ST4 append the machines that a batch changed (update mode) to a change
    log keyed by batch; ``live_kpi_table`` reads the latest state."""
    w = (live_machine_kpis(records).writeStream.outputMode("update")
         .foreachBatch(_log(table_path)).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=tick)
    return w.start()


def live_kpi_table(spark: SparkSession, table_path: str) -> DataFrame:
    """ST4 the latest row of every machine in the change log."""
    rows = spark.read.parquet(table_path)
    cols = [c for c in rows.columns if c not in ("machine_id", "batch_id")]
    return (rows.groupBy("machine_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
            .select("machine_id", "r.*"))


# --------------------------------------------------------------------------
# ST4, the plant's half: A1 over the last days of the stream
# --------------------------------------------------------------------------

def live_day_sums(records: DataFrame, days: int = 7) -> DataFrame:
    """ST4 sums per day. The state holds one row a day: tasks sum before the
    shuffle, and the watermark drops a day as soon as the trailing window of
    ``days`` days before the last one has left it. Rows of such days are late and
    no longer count."""
    day = F.col("production_date").cast("timestamp")
    return (records.withColumn("_day", day).withWatermark("_day", f"{days + 1} days").groupBy("_day")
            .agg(F.sum("units_produced").alias("su"), F.sum("defective_units").alias("sd"),
                 F.sum("downtime_min").alias("st"), F.count("downtime_min").alias("n"))
            .select(F.col("_day").cast("date").alias("production_date"), "su", "sd", "st", "n"))


def start_live_plant_kpis(records: DataFrame, checkpoint: str, table_path: str, days: int = 7,
                          available_now: bool = False, tick: str = TICK) -> StreamingQuery:
    """ST4 append the days that a batch changed to a change log keyed by batch."""
    w = (live_day_sums(records, days).writeStream.outputMode("update")
         .foreachBatch(_log(table_path)).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=tick)
    return w.start()


def _log(table_path: str):
    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(table_path, f"batch_id={batch_id}"))
    return log


def live_plant_kpis(spark: SparkSession, table_path: str, days: int = 7) -> DataFrame:
    """ST4 the plant KPIs (A1) of the last ``days`` days seen: each day's latest
    sums from the change log, its last day as the reference day."""
    rows = spark.read.parquet(table_path)
    day = rows.groupBy("production_date").agg(F.max_by(F.struct("su", "sd", "st", "n"), "batch_id").alias("r")).select(
        "production_date", "r.*")
    last = last_day(rows)
    agg = trailing_window(day, days, last).agg(
        F.sum("su").alias("su"), F.sum("sd").alias("sd"), F.sum("st").alias("st"),
        F.try_divide(F.sum("st"), F.sum("n")).alias("ad"), F.max("production_date").alias("last"))
    return kpi.plant_kpis_of_sums(agg, days, F.col("last"))


# --------------------------------------------------------------------------
# W8 as a stream: the latest reading of each machine
# --------------------------------------------------------------------------

READING = ["production_date", "units_produced", "defective_units", "downtime_min"]


def start_latest_readings(records: DataFrame, checkpoint: str, table_path: str, key: str = "event_id",
                          ts_col: str = "ts", watermark: str = "10 minutes", available_now: bool = False,
                          tick: str = TICK) -> StreamingQuery:
    """W8 the latest reading per machine, by event time.

    A reading that is sent again within the watermark counts once; keys older
    than the watermark leave the state. A batch is reduced to one row per machine
    before it is logged, so the log grows with machines, not with readings.
    """
    once = (records.withColumn("_event", F.col(ts_col).cast("timestamp")).withWatermark("_event", watermark)
            .dropDuplicatesWithinWatermark([key]).drop("_event"))

    def log(batch: DataFrame, batch_id: int) -> None:
        latest = windows.latest_reading(batch, ["machine_id"], [ts_col, key], READING)
        seen = batch.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_readings"))
        _log(table_path)(latest.join(seen, "machine_id"), batch_id)
    w = once.writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=tick)
    return w.start()


def latest_readings(spark: SparkSession, table_path: str, key: str = "event_id", ts_col: str = "ts") -> DataFrame:
    """W8 the machines' latest readings and how many distinct ones were seen. A
    late batch cannot replace a later reading, as event time decides."""
    rows = spark.read.parquet(table_path)
    last = windows.latest_reading(rows, ["machine_id"], [ts_col, key], READING)
    return last.join(rows.groupBy("machine_id").agg(F.sum("n_readings").alias("n_readings")), "machine_id")
