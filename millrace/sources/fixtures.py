"""Production-shaped views over the driver's TPC-H-ish parquet tables.

The driver's tables hold no production records, so these readers map them
(one production row per lineitem, one tenant per nation, one machine per
supplier, ...). Every reader selects only the source columns it needs, so
Catalyst prunes the parquet scan to them.
"""

from __future__ import annotations

import datetime as dt
import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order that makes production rows unique enough for
# row-order operators (date first, then the lineitem key columns).
ORDER_COLS = ["production_date", "l_orderkey", "l_linenumber", "l_partkey",
              "l_suppkey"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _padded(prefix: str, c: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def tenant_key(nation_col: str) -> Column:
    return _padded("PLANT_", F.col(nation_col), 2)


def machine_key(supp_col: str) -> Column:
    return _padded("M", F.col(supp_col), 4)


class Fixtures:
    """Lazily built DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @functools.cached_property
    def as_of(self) -> dt.date:
        """The last production day: one maximum over one column of lineitem."""
        last = self.raw("lineitem").agg(F.max("l_shipdate")).first()[0]
        return last.date() if last else dt.date.today()

    @functools.cached_property
    def production(self) -> DataFrame:
        return self._production(self.raw("lineitem"))

    def recent(self, days: int) -> DataFrame:
        """Production of the trailing window, filtered on the raw timestamp by a
        literal, so that the bound reaches the parquet scan."""
        start = dt.datetime.combine(self.as_of, dt.time()) - dt.timedelta(days=days)
        return self._production(self.raw("lineitem").filter(
            F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz")))

    def _production(self, lineitem: DataFrame) -> DataFrame:
        li = lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_discount", "l_tax", "l_returnflag", "l_shipdate")
        sup = self.raw("supplier").select("s_suppkey", "s_nationkey")
        units = F.col("l_quantity") * 10
        return (
            li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
            .select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                tenant_key("s_nationkey").alias("tenant_id"),
                F.col("l_shipdate").cast("date").alias("production_date"),
                machine_key("l_suppkey").alias("machine_id"),
                units.alias("units_produced"),
                F.floor(units * F.col("l_discount")).cast("double").alias("defective_units"),
                F.round(F.col("l_tax") * 1000).cast("double").alias("downtime_min"),
                F.when(F.col("l_returnflag") == "A", "Morning")
                 .when(F.col("l_returnflag") == "N", "Evening")
                 .otherwise("Night").alias("shift"),
            ))

    @functools.cached_property
    def production_dirty(self) -> DataFrame:
        p = self.production
        return p.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tenant_id",
            "production_date", "machine_id",
            F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
             .otherwise(F.col("units_produced")).alias("units_produced"),
            F.when(F.col("shift") == "Night", F.col("defective_units") * 15)
             .otherwise(F.col("defective_units")).alias("defective_units"),
            (F.col("downtime_min") - 20).alias("downtime_min"),
            "shift")

    @functools.cached_property
    def tenants(self) -> DataFrame:
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        return (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
                .select(tenant_key("n_nationkey").alias("tenant_id"),
                        F.col("n_name").alias("tenant_name"),
                        F.col("r_name").alias("plant_location"),
                        F.lit("UTC").alias("timezone"),
                        (F.col("n_nationkey") % 5 != 0).alias("is_active"),
                        F.lit("{}").alias("config")))

    @functools.cached_property
    def machines(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
        k = F.col("s_suppkey") % 3
        return s.select(
            tenant_key("s_nationkey").alias("tenant_id"),
            machine_key("s_suppkey").alias("machine_id"),
            F.col("s_name").alias("machine_name"),
            F.when(k == 0, "Assembly").when(k == 1, "Press").otherwise("Paint")
             .alias("machine_type"),
            F.col("s_acctbal").alias("capacity_units_per_hour"),
            (F.col("s_acctbal") >= 0).alias("is_active"))

    @functools.cached_property
    def user_grants(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_name", "c_nationkey",
                                        "c_acctbal", "c_mktsegment")
        seg = F.col("c_mktsegment")
        return c.select(
            F.col("c_custkey").alias("seq"),
            _padded("U", F.col("c_custkey") % 50, 4).alias("user_id"),
            tenant_key("c_nationkey").alias("tenant_id"),
            F.col("c_name").alias("user_name"),
            F.concat(F.col("c_name"), F.lit("@example.com")).alias("user_email"),
            F.when(seg == "BUILDING", "admin").when(seg == "MACHINERY", "manager")
             .otherwise("viewer").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"))

    @functools.cached_property
    def live_records(self) -> DataFrame:
        return live_from_events(self.raw("events"))

    @functools.cached_property
    def analysis_texts(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "text", "lang", "source")
        nl = F.lit("\n")
        return d.select("doc_id", F.concat(
            F.lit("Intro "), F.col("lang"), nl, F.lit("1. Executive Summary"), nl,
            F.col("text"), nl, F.lit("2. Empty"), nl, F.lit("3. Actions"), nl,
            F.lit("first"), nl, F.lit("4. Actions"), nl, F.lit("last "),
            F.col("source")).alias("text"))

    @functools.cached_property
    def unicode_texts(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "text")
        return d.select("doc_id", F.concat(
            F.lit("•–—‘’“”…°你\U0001F600 "),
            F.col("text")).alias("text"))


def live_from_events(events: DataFrame) -> DataFrame:
    """Map event rows to the live device record (works on batch or stream)."""
    return events.select(
        "event_id", "ts",
        F.col("ts").cast("date").alias("production_date"),
        F.concat(F.lit("OPC-UA-M"), (F.col("user_id") % 3 + 1).cast("string"))
         .alias("machine_id"),
        F.round(F.col("value") * 10).cast("double").alias("units_produced"),
        (F.col("event_id") % 15).cast("double").alias("defective_units"),
        (F.col("event_id") % 46).cast("double").alias("downtime_min"),
        F.lit("Live-Stream").alias("shift"))
