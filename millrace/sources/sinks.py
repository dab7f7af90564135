"""Writers and output shapes (K1-K6).

Appends are partitioned by day (and tenant) so readers prune by
directory; micro-batch writers key their output by batch id so a replayed
batch overwrites itself instead of duplicating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEEP_NULLS, iso_date

RECORD_FIELDS = ["production_date", "machine_id", "units_produced", "defective_units",
                 "downtime_min", "shift"]


def append_production(df: DataFrame, path: str) -> None:
    """K1 append live / legacy records, partitioned by ``production_date``."""
    _one_file_per_part(df, ["production_date"]).write.mode("append") \
        .partitionBy("production_date").parquet(path)


def append_tenant_production(df: DataFrame, path: str) -> None:
    """K2 append tenant records, partitioned by tenant then day."""
    _one_file_per_part(df, ["tenant_id", "production_date"]).write.mode("append") \
        .partitionBy("tenant_id", "production_date").parquet(path)


def _one_file_per_part(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gather a folder's rows before the write. A rebalance lets AQE split a
    folder that is too large for one task and merge small ones, so the number
    of files follows the bytes and not tasks x folders."""
    return df.hint("rebalance", *keys)


def write_validation_log(log_text: DataFrame, path: str) -> None:
    """K3 the validation log, rewritten on every run (one small text file)."""
    log_text.coalesce(1).write.mode("overwrite").text(path)


def records_json(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """K4 records as JSON objects with ISO dates (``to_json(struct(...))``)."""
    cols = [iso_date(F.col("production_date")).alias("production_date")]
    cols += [F.col(c) for c in RECORD_FIELDS[1:]]
    return df.select(*(keep or []), F.to_json(F.struct(*cols), KEEP_NULLS).alias("record"))


def write_insight_text(blocks: DataFrame, path: str) -> None:
    """K5 insight text blocks (one file per writer task, one line per block)."""
    blocks.select(F.to_json(F.struct(*blocks.columns), KEEP_NULLS).alias("value")) \
          .write.mode("overwrite").text(path)


def metric_sheet(df: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """K6 (metric, value-as-text) rows from a one-row-per-key KPI frame."""
    wide = df.select(*keys, *[F.col(c).cast("string").alias(name)
                              for name, c in metrics.items()])
    return wide.unpivot(keys, list(metrics), "metric", "value")


def write_metric_sheet(sheet: DataFrame, path: str, fmt: str = "parquet") -> None:
    sheet.write.mode("overwrite").format(fmt).save(path)
