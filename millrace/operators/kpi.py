"""Plant, machine and tenant KPIs (all single-plan aggregates).

Every aggregate is partial + final (map-side combine), so a hot machine or
tenant never moves more than one partial row per input partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (AsOf, as_of_col, safe_div, trailing_window, truncate_int,
                     zero_if_null)

# Fixed values from the reference's KPI formulas.
MINUTES_PER_DAY = 480          # efficiency: one 8-hour day per machine
MACHINES_ASSUMED = 3           # efficiency: plant size assumed by the formula
KWH_PER_UNIT = 0.5             # energy estimate
MINUTES_PER_CALENDAR_DAY = 1440


def _python_int_or_zero(c: Column) -> Column:
    """``int(x) if x else 0`` (null and 0 both give 0)."""
    return zero_if_null(truncate_int(c))


def plant_kpis(prod: DataFrame, days: int = 7, as_of: AsOf = None,
               machines: int = MACHINES_ASSUMED,
               minutes_per_day: int = MINUTES_PER_DAY) -> DataFrame:
    """A1 GET /api/kpis: one row of plant KPIs over the trailing window."""
    agg = trailing_window(prod, days, as_of).agg(
        F.sum("units_produced").alias("su"),
        F.sum("defective_units").alias("sd"),
        F.avg("downtime_min").alias("ad"),
        F.sum("downtime_min").alias("st"))
    return plant_kpis_of_sums(agg, days, as_of_col(as_of), machines, minutes_per_day)


def plant_kpis_of_sums(agg: DataFrame, days: int, as_of: Column, machines: int = MACHINES_ASSUMED,
                       minutes_per_day: int = MINUTES_PER_DAY) -> DataFrame:
    """A1 from one row of sums: su units, sd defects, st downtime, ad its mean."""
    tu = _python_int_or_zero(F.col("su"))
    td = _python_int_or_zero(F.col("sd"))
    theo = F.lit(float(days * minutes_per_day * machines))
    total_down = F.coalesce(F.col("st"), F.lit(0.0))
    positive = tu > 0
    return agg.select(
        tu.alias("total_units"),
        td.alias("total_defects"),
        F.round(F.when(positive, (tu - td) / tu * 100).otherwise(0.0), 2)
         .alias("yield_percentage"),
        F.round(F.when(positive, td / tu * 100).otherwise(0.0), 2).alias("defect_rate"),
        F.round(F.coalesce(F.col("ad"), F.lit(0.0)), 2).alias("avg_downtime"),
        F.round(total_down, 2).alias("total_downtime"),
        F.round(F.when(theo > 0, (theo - total_down) / theo * 100).otherwise(0.0), 2)
         .alias("efficiency"),
        F.date_format(as_of, "yyyy-MM-dd").alias("report_date"))


def report_kpis(df: DataFrame, group_cols: list[str] | None = None,
                as_of: AsOf = None) -> DataFrame:
    """A2 report KPIs (kpi_engine): totals truncated, yield from raw sums.

    ``group_cols`` gives the batch form (e.g. one row per tenant, A4).
    """
    group_cols = group_cols or []
    agg = df.groupBy(*group_cols).agg(
        F.sum("units_produced").alias("su"),
        F.sum("defective_units").alias("sd"),
        F.avg("downtime_min").alias("ad"))
    su, sd = F.col("su"), F.col("sd")
    return agg.select(
        *group_cols,
        truncate_int(su).alias("total_units"),
        truncate_int(sd).alias("total_defects"),
        F.round(F.when(su > 0, (su - sd) / su * 100).otherwise(0.0), 2)
         .alias("yield_pct"),
        F.round(F.col("ad"), 2).alias("avg_downtime_min"),
        F.date_format(as_of_col(as_of), "yyyy-MM-dd").alias("report_date"))


def machine_stats(prod: DataFrame, days: int | None = 7, as_of: AsOf = None,
                  group_cols: list[str] | None = None) -> DataFrame:
    """A3 GET /api/machines: per-machine sums (the caller orders them)."""
    keys = (group_cols or []) + ["machine_id"]
    src = prod if days is None else trailing_window(prod, days, as_of)
    return (src.groupBy(*keys)
            .agg(F.sum("units_produced").alias("units_produced"),
                 F.sum("defective_units").alias("defective_units"),
                 F.sum("downtime_min").alias("downtime_minutes")))


def tenant_kpis(prod: DataFrame, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """A4 GET /{tenant}/kpis in batch form: one KPI row per tenant.

    Tenants without rows in the window are absent (the reference returns an
    empty KPI set for them).
    """
    return report_kpis(trailing_window(prod, days, as_of), ["tenant_id"], as_of)


def additional_metrics(prod: DataFrame, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """A6 energy and cycle time."""
    agg = trailing_window(prod, days, as_of).agg(
        F.sum("units_produced").alias("su"), F.sum("downtime_min").alias("st"))
    tu = _python_int_or_zero(F.col("su"))
    total_down = F.coalesce(F.col("st"), F.lit(0.0))
    available = F.lit(float(days * MINUTES_PER_CALENDAR_DAY)) - total_down
    return agg.select(
        F.round(tu * KWH_PER_UNIT, 2).alias("energy_consumption_kwh"),
        F.round(F.when(tu > 0, available / tu).otherwise(0.0), 2)
         .alias("avg_cycle_time_min"),
        tu.alias("total_units"),
        F.lit(days).alias("days_analyzed"))


def insight_kpis(prod: DataFrame, days: int | None = 7, as_of: AsOf = None,
                 group_cols: list[str] | None = None) -> DataFrame:
    """A7 KPI input of the insight route: int totals, unrounded yield.

    ``days=None`` aggregates the frame as given (no window).
    """
    group_cols = group_cols or []
    src = prod if days is None else trailing_window(prod, days, as_of)
    agg = src.groupBy(*group_cols).agg(
        F.sum("units_produced").alias("su"), F.sum("defective_units").alias("sd"),
        F.avg("downtime_min").alias("ad"))
    tu = _python_int_or_zero(F.col("su"))
    td = _python_int_or_zero(F.col("sd"))
    return agg.select(
        *group_cols, tu.alias("total_units"), td.alias("total_defects"),
        F.when(tu > 0, (tu - td) / tu * 100).otherwise(0.0).alias("yield_percentage"),
        F.coalesce(F.col("ad"), F.lit(0.0)).alias("avg_downtime"))


def shift_machine_chart(df: DataFrame) -> DataFrame:
    """A8 production-by-shift chart data: mean, n and sample std per bar."""
    return df.groupBy("shift", "machine_id").agg(
        F.avg("units_produced").alias("mean_units"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("units_produced").alias("std_units"))


def machine_downtime_chart(df: DataFrame) -> DataFrame:
    """A8 downtime-by-machine chart data."""
    return df.groupBy("machine_id").agg(
        F.avg("downtime_min").alias("mean_downtime"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("downtime_min").alias("std_downtime"))


#: Replicates and level of a chart's interval; a replicate's weights are Poisson(1).
BOOT_REPLICATES = 128
BOOT_LEVEL = 0.95
PRIME, STEP = 2**31 - 1, 48271   # a row's draws: seed * STEP^k modulo PRIME
BOOT_ROWS = 512                  # rows drawn for at a time


def draw_steps(replicates: int = BOOT_REPLICATES) -> list[int]:
    """The multiplier of a row's seed for each replicate."""
    return [pow(STEP, k, PRIME) for k in range(1, replicates + 1)]


def poisson_cuts() -> list[int]:
    """Bounds of the Poisson(1) distribution function over 1..PRIME: the weight
    of a draw is the number of bounds not above it."""
    cuts, total = [], 0.0
    for k in range(20):
        total += math.exp(-1) / math.factorial(k)
        if round(total * PRIME) < PRIME:
            cuts.append(round(total * PRIME))
    return cuts


def _replicate_sums(group_cols: list[str], replicates: int):
    """Partial sums of the replicates for each group of a batch (numpy)."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, prime = np.array(draw_steps(replicates), dtype=np.uint64), np.uint64(PRIME)
        cuts = np.array(poisson_cuts(), dtype=np.int32)
        for rows in batches:
            if rows.empty:
                continue
            groups = rows.groupby(group_cols, dropna=False, sort=False)
            code = groups.ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            code, v = code[order], rows["_v"].to_numpy(dtype="float64")[order]
            seed = rows["_seed"].to_numpy(dtype=np.uint64)[order]
            total = np.zeros((code[-1] + 1, replicates))
            weights = np.zeros(total.shape, dtype=np.int64)
            for lo in range(0, len(v), BOOT_ROWS):
                part = slice(lo, lo + BOOT_ROWS)
                u = seed[part, None] * steps                     # below 2^62
                u = (u & prime) + (u >> np.uint64(31))           # the same modulo 2^31 - 1
                u = np.where(u >= prime, u - prime, u).astype(np.int32)
                w = np.zeros(u.shape, dtype=np.uint8)
                for cut in cuts:
                    w += u >= cut
                c = code[part]
                start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                total[c[start]] += np.add.reduceat(v[part, None] * w, start, axis=0)
                weights[c[start]] += np.add.reduceat(w, start, axis=0, dtype=np.int64)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            out = rows[group_cols].iloc[order[first]].reset_index(drop=True)
            out["_total"], out["_weights"] = list(total), list(weights)
            out["_sum"], out["_rows"] = np.add.reduceat(v, first), np.diff(np.r_[first, len(v)])
            yield out
    return sums


def bootstrap_interval(df: DataFrame, group_cols: list[str], value: str, key_cols: list[str],
                       replicates: int = BOOT_REPLICATES, level: float = BOOT_LEVEL) -> DataFrame:
    """A8 (groups, mean, n, lower, upper): bootstrap interval of each bar's mean.

    A row's weight in each replicate comes from a multiplicative sequence
    seeded by the SHA-256 of its key, so reruns and other engines agree. Rows are
    dealt by ranges of group and key, so that a group lies together and a large one
    is several tasks; each batch gives one row of partial sums a group. Null values are left
    out; a group without values has no row; replicates of total weight zero don't count.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    seed = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.lit(PRIME - 1) + 1
    rows = (df.filter(F.col(value).isNotNull())
            .select(*dict.fromkeys([*group_cols, *key_cols]), F.col(value).cast("double").alias("_v"))
            .repartitionByRange(*dict.fromkeys([*group_cols, *key_cols])).sortWithinPartitions(*group_cols)
            .select(*group_cols, "_v", seed.alias("_seed")))
    schema = T.StructType([rows.schema[c] for c in group_cols]).add("_total", T.ArrayType(T.DoubleType())).add(
        "_weights", T.ArrayType(T.LongType())).add("_sum", "double").add("_rows", "long")
    partial = rows.mapInPandas(_replicate_sums(group_cols, replicates), schema)
    sums = (partial.select(*group_cols, "_sum", "_rows", F.posexplode(F.arrays_zip("_total", "_weights")).alias("_b", "_x"))
            .groupBy(*group_cols, "_b").agg(
                F.sum("_x._total").alias("_s"), F.sum("_x._weights").alias("_n"),
                (F.sum("_sum") / F.sum("_rows")).alias("_mean"), F.sum("_rows").alias("_rows")))
    tail = (1 - level) / 2
    means = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    return sums.groupBy(*group_cols).agg(
        F.min_by("_mean", "_b").alias("mean"), F.max("_rows").alias("n"),
        F.percentile(means, F.lit(tail)).alias("lower"), F.percentile(means, F.lit(1 - tail)).alias("upper"))


def defect_rate_check(df: DataFrame, group_cols: list[str] | None = None,
                      threshold: float = 0.05) -> DataFrame:
    """A9 overall defect rate sum(defects)/sum(units) against 5 %."""
    group_cols = group_cols or []
    return df.groupBy(*group_cols).agg(
        safe_div(F.sum("defective_units"), F.sum("units_produced")).alias("defect_rate")
    ).withColumn("above_threshold", F.col("defect_rate") > F.lit(threshold))


def quality_percentage(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A12 defects / units x 100; zero units gives null."""
    group_cols = group_cols or []
    return df.groupBy(*group_cols).agg(
        F.sum("units_produced").alias("total_units"),
        F.sum("defective_units").alias("total_defects"),
    ).withColumn("defect_pct",
                 safe_div(F.col("total_defects"), F.col("total_units")) * 100)


def series_std(df: DataFrame, series: list[str], value: str = "downtime_min") -> DataFrame:
    """A10 sample standard deviation (n-1) per series."""
    return df.groupBy(*series).agg(F.stddev_samp(value).alias("std"),
                                   F.count(F.lit(1)).alias("n"))
