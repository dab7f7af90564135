"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable in ``edges``.

    ``edges`` has two long columns a, b; ids without an edge don't appear. Each
    round joins every node with its smallest neighbour (an aggregate, so a
    node with very many neighbours is combined before the shuffle, and the
    join back can be split) and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = materialize(_pairs(edges.select("a", "b")), "edges")
    mark = _mark(now)
    while True:
        new = materialize(_small_star(_large_star(now)), "edges")
        seen = _mark(new)
        if seen == mark:
            break
        now, mark = new, seen
    return (now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
            .unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct())


def _pairs(edges: DataFrame) -> DataFrame:
    return (edges.filter("a <> b")
            .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's smallest neighbour."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    linked = edges.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return _pairs(linked.unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b"))))
