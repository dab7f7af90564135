"""Shared helpers: written intermediate tables, checked broadcasts, row keys."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Largest number of rows that ``small_side`` marks for broadcast; its callers
#: pass rows of at most two numbers, so this bounds a broadcast to some MB.
BROADCAST_ROWS = 200_000


#: bytes of a batch of rows that a Python worker gets at once
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """What the queries and stages need of a session: the package on the
    executors, and batches bounded by bytes, as texts may be very long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what this Python process has freed to the system. A worker waits
    for its next task beside the executor's JVM, and freed blocks of a batch
    would stay its own until then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def giving_back(part: Callable[..., Iterator[pd.DataFrame]]) -> Callable[..., Iterator[pd.DataFrame]]:
    """``part`` (of ``mapInPandas``), which frees its memory at the end of a task."""
    @functools.wraps(part)
    def run(batches: Iterator[pd.DataFrame], *args, **named) -> Iterator[pd.DataFrame]:
        yield from part(batches, *args, **named)
        give_back()
    return run


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` under the session's shared checkpoint folder and reread it.

    Cuts the lineage once (``checkpoint()`` would run the plan twice) and
    leaves a table that outlives any executor. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows.

    Beyond that the hint is left out and the planner shuffles both sides; the
    result is the same either way. ``df`` should be a written table of narrow
    rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as 0 (held out)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sum_arrays(rows: DataFrame, size: int, fan: int = 32) -> np.ndarray:
    """Sum of float64 arrays (column v, binary), one for each partition number g.

    At most ``fan`` arrays come together at once: neighbours are summed level by
    level until that many are left for the driver. Sums are taken in order of g,
    so reruns agree."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for v in pdf.sort_values("g")["v"]:
            total += np.frombuffer(v)
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0]) // fan], "v": [total.tobytes()]})

    left = rows.rdd.getNumPartitions()
    while left > fan:
        rows = rows.groupBy(F.floor(F.col("g") / fan).alias("up")).applyInPandas(merge, "g int, v binary")
        left = -(-left // fan)
    return sum((np.frombuffer(r["v"]) for r in sorted(rows.select("g", "v").collect())), np.zeros(size))
