"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
a stage's result as Parquet under the shared checkpoint folder and rereads it
as the next stage's input. All but the last return the columns of documents.

A row is known between scans by its doc_id and a hash of its text, so rows
that repeat both are judged alike; near duplicates keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, jaccard, mixing, pii, quality
from millrace.llm.common import materialize, prepare, small_side, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    prepare(spark)
    judged = quality.score(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))
    return quality.without(docs, judged.filter("NOT kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    prepare(spark)
    judged = materialize(jaccard.join_groups(docs).select("doc_id", "text_key", "kept"), "judged")
    left = quality.without(docs, judged.filter("NOT kept"))
    again = small_side(materialize(
        judged.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_i"), F.col("text_key").alias("_t"))
        .count().filter("count > 1").select("_i", "_t"), "repeated"))
    same = (docs["doc_id"].cast("long") == again["_i"]) & (F.xxhash64(docs["text"]) == again["_t"])
    if again.isEmpty():
        return left
    own = "_text_key_of_" + "_".join(docs.columns)  # a name that no column has
    once = left.join(again, same, "left_semi").withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own])
    return left.join(again, same, "left_anti").unionByName(once.drop(own))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    prepare(spark)
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return quality.without(docs, found.filter("contaminated").select("doc_id", "text_key"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    prepare(spark)
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    prepare(spark)
    return mixing.mix_sources(docs)


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("benchmark decontamination", benchmark_stage), ("PII", pii_stage),
          ("mixing sources to target weights", mixing_stage)]

#: the classifier and the pruned join have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
