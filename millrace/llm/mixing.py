"""Mixing sources to target weights: Sainte-Lague apportionment of token blocks.

All steps are DataFrame operations. A source's target comes from its weight;
targets are turned into whole blocks of ``block_words`` words by highest
quotients (votes / 1, 3, 5, ...), first over sources, then, within a source,
over its shards. A shard is a seeded hash slice of the source's documents, so
a source that holds a third of all rows is many shards and no window or task
holds a source. The documents of a shard, in seeded order, form one stream of
words cut into equal blocks; a shard's quota takes every block ``quota div
blocks`` times and ``quota mod blocks`` more blocks at seeded even steps, so a
document's share is arithmetic on its place in the stream: blocks are never
rows.

Defined cases: a null text has size 0; the null source is a source of its own,
last; a document of size 0 is taken 0 times; repeated rows are documents of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0,
                 most: float = 3.0) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source with ``source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size
    and the excess is shared again by weight. That end state is a water level:
    with sources sorted by cap / weight, the first k stop at their caps, where
    k is the first for which (rest of the total) / (rest of the weights) does
    not exceed the next cap / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.row_number().over(order) - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(),
                          F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    return (
        sources.withColumn("weight", w)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(rest))
        .withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("weight"))
        .withColumn("_water", F.min(F.when(F.col("_open"), F.struct(
            F.col("_cap") / F.col("weight"), F.col("_level")))).over(everything)["_level"])
        .withColumn("target", F.when(F.col("_water").isNull(), F.col("_cap"))
                    .otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("weight"))))
        .drop("_cap", "_total", "_level", "_open", "_water"))


def sainte_lague(df: DataFrame, votes: str, seats: Column, by: list[str], out: str) -> DataFrame:
    """Add ``out``: the seats each row gets by the highest quotients.

    ``df`` has one row per party of a group ``by``; ``seats`` (constant in a
    group) are dealt out by the quotients votes / (2 k + 1). Every party's seat
    number lies within a short, provable interval around its rounded share
    (``share`` of the parties' number wide), so only those quotients are ranked:
    at most a few per party on average. Ties go to the smaller ``_key``.
    """
    group = Window.partitionBy(*by)
    lean = (df.withColumn("_n", F.count(F.lit(1)).over(group))
            .withColumn("_v", F.sum(votes).over(group).cast("double"))
            .withColumn("_seats", seats)
            .withColumn("_share", F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0))
            .withColumn("_slack", F.ceil(F.col("_n") * F.col("_share")) + 1)
            .withColumn("_low", F.greatest(F.lit(0).cast("bigint"), F.floor(
                F.col("_share") * F.col("_seats")) - F.col("_slack"))))
    lean = lean.withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    tried = lean.filter(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence(
        F.col("_low"), F.col("_low") + 2 * F.col("_slack") + 2)))
    rank = Window.partitionBy(*by).orderBy(
        (F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col("_key"), F.col("_k"))
    won = (tried.withColumn("_r", F.row_number().over(rank))
           .filter(F.col("_r") <= F.col("_left"))
           .groupBy("_key").agg(F.count(F.lit(1)).alias("_won")))
    return (lean.join(won, "_key", "left")
            .withColumn(out, F.when(F.col(votes) > 0, F.col("_low") + F.coalesce("_won", F.lit(0)))
                        .otherwise(F.lit(0)).cast("bigint"))
            .drop("_n", "_v", "_seats", "_share", "_slack", "_low", "_left", "_won"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, most: int = 3,
                block_words: int = 16, shard_words: int = 250_000, seed: int = 7,
                keep: tuple = (), shard_rows: int = 250_000) -> DataFrame:
    """One row per document: size, source_size, target, taken and its place.

    ``shard_words`` is the aimed number of words of a shard, ``shard_rows`` the
    most rows aimed at (documents without words are rows too), ``keep`` names
    further columns to carry along.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialize(docs.select(
        "doc_id", "source", *keep, size.alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text")).alias("_h")), "mix-sizes")

    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    src = (with_targets(src, weights, share, most)
           .withColumn("_key", F.row_number().over(Window.orderBy(
               F.col("source").isNull(), F.col("source").cast("binary"))))
           .withColumn("_all", F.lit(1)))
    total = F.sum("target").over(Window.partitionBy("_all"))
    src = materialize(
        sainte_lague(src, "target", F.round(total / block_words).cast("bigint"), ["_all"], "blocks")
        .withColumn("shards", F.greatest(F.lit(1).cast("bigint"),
                                         F.floor(F.col("source_size") / shard_words),
                                         F.floor(F.col("_rows") / shard_rows)))
        .select("source", "source_size", "target", "blocks", "shards",
                F.col("_key").alias("source_no")), "mix-sources")

    cond = rows["source"].eqNullSafe(src["source"])
    placed = (rows.join(small_side(src), cond, "inner").drop(src["source"])
              .withColumn("shard", F.pmod(F.xxhash64("_h"), F.col("shards"))))
    stream = Window.partitionBy("source_no", "shard").orderBy("_h", "doc_id", "size")
    placed = materialize(
        placed.withColumn("_to", F.sum("size").over(
            stream.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_from", F.col("_to") - F.col("size")), "mix-placed")

    shards = (placed.groupBy("source_no", "shard", "blocks")
              .agg(F.sum("size").alias("shard_size"))
              .withColumn("_key", F.struct("source_no", "shard")))
    quotas = (sainte_lague(shards, "shard_size", F.col("blocks"), ["source_no"], "quota")
              .withColumn("_n", F.ceil(F.col("shard_size") / block_words))
              .withColumn("_q", F.least(F.col("quota"), F.col("_n") * most))
              .withColumn("_all", F.when(F.col("_n") > 0, F.expr("_q div _n")).otherwise(0))
              .withColumn("_some", F.when(F.col("_n") > 0, F.expr("_q % _n")).otherwise(0))
              .withColumn("_phase", F.when(F.col("_n") > 0, F.pmod(
                  F.xxhash64(F.lit(seed), F.col("source_no"), F.col("shard")), F.col("_n")))
                  .otherwise(0))
              .select(F.col("source_no").alias("_s"), F.col("shard").alias("_d"),
                      "shard_size", "quota", "_n", "_all", "_some", "_phase"))
    out = placed.join(quotas, (F.col("source_no") == F.col("_s")) & (F.col("shard") == F.col("_d")))

    def words_before(at: str) -> str:
        """Words of the blocks taken by the seeded even step, up to place ``at``.

        Block j is taken if (j + phase) * some runs over a multiple of n, so
        any n neighbouring blocks hold exactly ``some`` taken ones.
        """
        def picked(block: str) -> str:
            return f"((({block}) + _phase) * _some) div _n - (_phase * _some) div _n"
        block = f"{at} div {block_words}"
        return (f"(({picked(block)}) * {block_words} + (({picked(block + ' + 1')}) - "
                f"({picked(block)})) * ({at} % {block_words}))")

    extra = f"{words_before('_to')} - {words_before('_from')}"
    taken = F.expr(f"_all * size + CASE WHEN _some > 0 THEN {extra} ELSE 0 END")
    return out.select("doc_id", "source", *keep, "size", "source_size", "target",
                      taken.cast("bigint").alias("taken"), "shard", "quota")
