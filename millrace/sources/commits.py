"""Appends that count once: staged files, then a commit record per batch id.

A batch is written to a folder of its own, ``data/batch=<token>``. It belongs to
the table from the moment its record appears under ``commits``; the record is
made by one rename that fails if the batch id has one already. So a batch that
fails half-way adds nothing, a batch that runs again adds nothing more, and
readers never see part of one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "batch_id string, batch string"


def _files(spark: SparkSession, path: str):
    """The file system's paths and operations, as Spark itself reaches them."""
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(jvm.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    return jvm, context


def stage(df: DataFrame, table: str, partition_by: list[str]) -> str:
    """Write a batch where no reader looks yet; returns its token."""
    token = uuid.uuid4().hex
    df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(f"{table}/data/batch={token}")
    return token


def commit(spark: SparkSession, table: str, batch_id: str, token: str) -> bool:
    """Make a staged batch part of the table. False if its id was committed
    before; the files then stay unread."""
    return publish(spark, {"batch_id": batch_id, "batch": token}, f"{table}/commits", batch_id)


def publish(spark: SparkSession, record: dict, folder: str, name: str) -> bool:
    """Make ``folder/name.json`` hold ``record``, whole or not at all. False if
    the name is taken."""
    draft = f"{folder}-drafts/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(draft)
    jvm, context = _files(spark, folder)
    part = next(s.getPath() for s in _listed(context, jvm.Path(draft)) if s.getPath().getName().startswith("part-"))
    context.mkdir(jvm.Path(folder), None, True)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(part, jvm.Path(f"{folder}/{name}.json"), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _listed(context, path):
    found = context.listStatus(path)
    while found.hasNext():
        yield found.next()


def committed(spark: SparkSession, table: str) -> DataFrame:
    """(batch_id, batch) of the batches that belong to the table."""
    try:
        return spark.read.schema(COMMIT).json(f"{table}/commits")
    except AnalysisException:      # nothing committed yet
        return spark.createDataFrame([], COMMIT)


def append(df: DataFrame, table: str, batch_id: str, partition_by: list[str]) -> bool:
    """Append ``df`` once. A batch id that was committed before writes nothing."""
    spark = df.sparkSession
    if not committed(spark, table).filter(F.col("batch_id") == batch_id).isEmpty():
        return False
    return commit(spark, table, batch_id, stage(df, table, partition_by))


def read(spark: SparkSession, table: str, schema: T.StructType, batches: DataFrame | None = None) -> DataFrame:
    """The committed rows, or those of ``batches`` (batch). ``batch`` is a
    partition column, so the join prunes folders."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    try:
        rows = spark.read.schema(full).parquet(f"{table}/data")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    of = committed(spark, table) if batches is None else batches
    return rows.join(of.select("batch"), "batch", "left_semi").select(*schema.fieldNames())
