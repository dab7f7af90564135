"""D1 bucketed storage of production rows.

Rows are dealt into buckets by (production_date, machine_id) and sorted in
them. Joins and windows on that pair then read the buckets as they lie: the
migration (J3) and the row pass of every series window need no exchange of
facts. The pair, not the tenant or machine alone, is the key, so a plant or a
machine with a third of all rows is spread over all buckets; one machine's day
is what a bucket can't split. Joins with tenants or machines don't need
buckets: those sides are small and broadcast by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKET_KEYS = ["production_date", "machine_id"]


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: list[str] | None = None,
                   append: bool = False) -> DataFrame:
    """Store ``df`` as the bucketed table ``table`` at ``path`` and return it.

    The shuffle before the write uses the buckets' own hash, so a bucket is one
    file a write. Choose ``buckets`` for about 1 GB a bucket (100,000 for 100 TB,
    Spark's limit for one table). ``append`` adds files to the buckets of a
    table that has the same keys and number of buckets.
    """
    keys = keys or BUCKET_KEYS
    (df.repartition(buckets, *keys).write.format("parquet").mode("append" if append else "errorifexists")
     .bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table))
    return read_bucketed(df.sparkSession, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The stored rows of a bucketed table, files of later appends included."""
    spark.catalog.refreshTable(table)
    return spark.table(table)
