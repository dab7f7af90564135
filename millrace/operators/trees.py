"""Tree ensembles of many groups in one plan (M4-M6, second order).

Every group (tenant) gets its own forest and its own boosted trees. Features
become bins; a level of trees grows from one aggregate, the sums of gradients
and Hessians per (group, tree, node, feature, bin), and a split is the bin with
the largest regularised gain

    (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l)) / 2.

For the squared error the gradient is prediction - label and the Hessian 1. A
forest is the same with labels as negative gradients, no regularisation and
bootstrap counts as Hessians. Gains are compared to six decimals; of equal ones
the first feature, then the lowest bin wins, so that the order of summing does
not pick the split.

Rows are scored while the trees grow: rows that don't train (held-out rows, a
scenario) go through the splits with weight zero. Groups of at most
``local_rows`` rows grow all their trees in one task; larger ones level by level
over all tasks, by the same sums and the same rule.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

# Sizes and rates of the two ensembles.
FOREST_TREES, FOREST_DEPTH = 100, 10
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE = 100, 6, 0.1
REGULARISATION, MIN_HESSIAN = 1.0, 1.0

BINS = 64
LOCAL_ROWS = 50_000
SEED = 42

#: cumulative Poisson(1) probabilities of 0 to 5, in 10^-6: bootstrap counts
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406)

GROWN = ("kind string, row_id long, forest_pred double, boost_pred double, feature int, importance double")


# --------------------------------------------------------------------------
# bins
# --------------------------------------------------------------------------

def bin_edges(rows: DataFrame, cols: list[str], group: str, bins: int = BINS, method: str = "quantile") -> DataFrame:
    """(group, edges): per feature the upper bounds of all bins but the last.

    ``quantile`` takes approximate quantiles, ``width`` bins of equal width.
    """
    def edges(c: str) -> Column:
        if method == "width":
            lo, hi = F.min(c), F.max(c)
            return F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: lo + i * (hi - lo) / bins)
        return F.array_distinct(F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000))
    return rows.groupBy(group).agg(F.array(*[edges(c) for c in cols]).alias("edges"))


def binned(rows: DataFrame, cols: list[str]) -> Column:
    """Bins of a row that has its group's ``edges``: the edges below each value.
    A null value is in the first bin.

    The edges ascend, so their number is the value's first place among them,
    without a lambda's call for each edge."""
    def one(k: int, c: str) -> Column:
        value = F.col(c).cast("double")
        among = F.sort_array(F.array_append(F.col("edges")[k].cast("array<double>"), value))
        return F.coalesce((F.array_position(among, value) - 1).cast("int"), F.lit(0))
    return F.array(*[one(k, c) for k, c in enumerate(cols)])


def bootstrap_count(row_id: Column, tree: Column, seed: int = SEED) -> Column:
    """How often a tree's sample holds a row: Poisson(1) by a hash of both."""
    u = F.pmod(F.xxhash64(row_id, tree, F.lit(seed)), F.lit(1_000_000))
    return reduce(lambda n, p: n + (u >= p).cast("int"), POISSON, F.lit(0))


# --------------------------------------------------------------------------
# one level over all tasks
# --------------------------------------------------------------------------

def node_sums(rows: DataFrame, model: list[str]) -> DataFrame:
    """(model, node, feature, bin, g, h): the histogram of one level."""
    return (rows.filter("h > 0").select(*model, "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            .groupBy(*model, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))


def split_gains(sums: DataFrame, model: list[str], reg: float = REGULARISATION,
                min_hessian: float = MIN_HESSIAN) -> DataFrame:
    """Every admissible split with its gain. A (model, node, feature) has at most
    as many rows as there are bins, so its window is small."""
    w = Window.partitionBy(*model, "node", "feature")
    left = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sums.withColumns({"gl": F.sum("g").over(left), "hl": F.sum("h").over(left),
                          "gt": F.sum("g").over(w), "ht": F.sum("h").over(w)})
    s = s.withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    s = s.filter((F.col("hl") >= min_hessian) & (F.col("hr") >= min_hessian))

    def part(g: str, h: str) -> Column:
        return F.col(g) * F.col(g) / (F.col(h) + reg)
    return s.withColumn("gain", F.round((part("gl", "hl") + part("gr", "hr") - part("gt", "ht")) / 2, 6)).select(
        *model, "node", "feature", "bin", "gain", "gt", "ht")


def best_splits(gains: DataFrame, model: list[str]) -> DataFrame:
    """(model, node, feature, bin, gain, gt, ht) of each node that gains."""
    best = F.max_by(F.struct("feature", "bin", "gain", "gt", "ht"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return gains.filter("gain > 0").groupBy(*model, "node").agg(best.alias("s")).select(*model, "node", "s.*")


def descend(rows: DataFrame, splits: DataFrame, model: list[str]) -> DataFrame:
    """Rows of split nodes go to child 2n or 2n + 1; others stay."""
    s = splits.select(*model, "node", F.col("feature").alias("_f"), F.col("bin").alias("_b"))
    right = (F.element_at("bins", F.col("_f") + 1) > F.col("_b")).cast("int")
    return (rows.join(s, [*model, "node"], "left")
            .withColumn("node", F.when(F.col("_f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right))
            .drop("_f", "_b"))


def grow(rows: DataFrame, model: list[str], depth: int, reg: float, tag: str) -> tuple[DataFrame, DataFrame]:
    """Grow one tree per model over all tasks: (rows with ``value``, splits).

    ``rows`` holds model, bins, g, h. Only splits are written between levels.
    """
    rows, found = rows.withColumn("node", F.lit(1)), []
    for _ in range(depth):
        splits = write_table(best_splits(split_gains(node_sums(rows, model), model, reg), model), tag)
        if splits.isEmpty():
            break
        found.append(splits)
        rows = descend(rows, splits, model)
    leaves = rows.filter("h > 0").groupBy(*model, "node").agg((-F.sum("g") / (F.sum("h") + reg)).alias("value"))
    splits = reduce(DataFrame.unionByName, found) if found else splits
    return rows.join(leaves, [*model, "node"], "left"), splits


# --------------------------------------------------------------------------
# the same levels of one group in numpy
# --------------------------------------------------------------------------

def grow_local(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, reg: float,
               gains: np.ndarray | None = None) -> np.ndarray:
    """One tree over the rows of a group: the leaf value of each row. Adds the
    gains of its splits by feature to ``gains``."""
    n, f = bins.shape
    width = int(bins.max()) + 1 if n else 1
    node = np.zeros(n, dtype=np.int64)      # place among the nodes of this level, -1: in a leaf
    value = np.zeros(n)
    offset = np.arange(f) * width
    for _ in range(depth):
        count = int(node.max()) + 1 if n else 0
        inside = np.flatnonzero(node >= 0)
        if not count or not len(inside):
            break
        key = (node[inside, None] * (f * width) + offset + bins[inside]).ravel()
        shape = (count, f, width)
        gs = np.bincount(key, np.repeat(g[inside], f), minlength=count * f * width).reshape(shape)
        hs = np.bincount(key, np.repeat(h[inside], f), minlength=count * f * width).reshape(shape)
        gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        gr, hr = gt - gl, ht - hl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.round((gl * gl / (hl + reg) + gr * gr / (hr + reg) - gt * gt / (ht + reg)) / 2, 6)
        gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = 0.0
        gain = gain.reshape(count, -1)
        best = gain.argmax(axis=1)
        top = gain[np.arange(count), best]
        splits = top > 0
        feature, cut = best // width, best % width
        if gains is not None:
            np.add.at(gains, feature[splits], top[splits])
        # nodes that don't split are leaves of this value
        leaf = -gt[:, 0, 0] / np.maximum(ht[:, 0, 0] + reg, 1e-300)
        at = node[inside]
        stay = ~splits[at]
        value[inside[stay]] = leaf[at[stay]]
        child = 2 * (np.cumsum(splits) - 1)
        go = inside[~stay]
        right = bins[go, feature[node[go]]] > cut[node[go]]
        node[inside[stay]] = -1
        node[go] = child[node[go]] + right
    inside = np.flatnonzero(node >= 0)
    if len(inside):
        count = int(node.max()) + 1
        gt = np.bincount(node[inside], g[inside], minlength=count)
        ht = np.bincount(node[inside], h[inside], minlength=count)
        value[inside] = (-gt / np.maximum(ht + reg, 1e-300))[node[inside]]
    return value


def _local(rounds: int, trees: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        bins = np.array(rows["bins"].tolist(), dtype=np.int64)
        y, w = rows["label"].to_numpy(float), rows["is_train"].to_numpy(float)
        counts = np.array(rows["counts"].tolist(), dtype=float)
        y = np.where(w > 0, y, 0.0)
        n, f = bins.shape
        margin = np.full(n, (y * w).sum() / max(w.sum(), 1.0))
        for _ in range(rounds):
            margin = margin + BOOST_RATE * grow_local(bins, (margin - y) * w, w, BOOST_DEPTH, REGULARISATION)
        forest, importance = np.zeros(n), np.zeros(f)
        used = 0
        for t in range(trees):
            h = counts[:, t] * w
            if not h.sum():
                continue
            used += 1
            own = np.zeros(f)
            forest += grow_local(bins, -y * h, h, FOREST_DEPTH, 0.0, own)
            importance += own / own.sum() if own.sum() > 0 else own
        total = importance.sum()
        nan = np.full(f, np.nan)
        return pd.DataFrame({
            "kind": ["row"] * n + ["importance"] * f,
            "row_id": np.concatenate([rows["row_id"].to_numpy(np.int64), np.zeros(f, np.int64)]),
            "forest_pred": np.concatenate([forest / max(used, 1), nan]), "boost_pred": np.concatenate([margin, nan]),
            "feature": np.concatenate([np.full(n, -1), np.arange(f)]).astype(np.int32),
            "importance": np.concatenate([np.full(n, np.nan), importance / total if total > 0 else importance])})
    return run


# --------------------------------------------------------------------------
# both ensembles of every group
# --------------------------------------------------------------------------

def train_groups(rows: DataFrame, cols: list[str], group: str, label: str, row_id: str = "row_id",
                 rounds: int = BOOST_ROUNDS, trees: int = FOREST_TREES, bins: int = BINS,
                 local_rows: int = LOCAL_ROWS, method: str = "quantile") -> tuple[DataFrame, DataFrame]:
    """Grow and score a forest and boosted trees per group.

    ``rows`` has ``group``, ``row_id`` (long, unique in its group), ``is_train``,
    ``label`` and ``cols``. Returns (group, row_id, forest_pred, boost_pred) for
    all rows and (group, feature, importance), the share of the forest's gain.
    A group without a training row has predictions zero.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(group).alias("grp"), F.col(row_id).alias("row_id"), F.coalesce("is_train", F.lit(False)).alias("is_train"),
                       F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols])
    edges = bin_edges(base.filter("is_train"), cols, "grp", bins, method)
    data = write_table(base.join(edges, "grp", "left").select(
        "grp", "row_id", F.col("is_train").alias("is_train"), F.coalesce("label", F.lit(0.0)).alias("label"),
        F.when(F.col("edges").isNull(), F.array(*[F.lit(0)] * len(cols))).otherwise(binned(base, cols)).alias("bins")),
        "trees-rows")
    sizes = write_table(data.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows")), "trees-sizes")
    large = sizes.filter(F.col("n_rows") > local_rows)

    counts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: bootstrap_count(F.col("row_id"), t))
    small = data.join(sizes.filter(F.col("n_rows") <= local_rows).select("grp"), "grp")
    kind = data.schema["grp"].dataType.simpleString()

    grow_one = _local(rounds, trees)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = grow_one(frame)
        out.insert(0, "grp", key[0])
        return out
    # few bytes are much work here: a fixed number of partitions is not merged by size
    spread = small.withColumn("counts", counts).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp")
    grown = write_table(spread.groupBy("grp").applyInPandas(run, f"grp {kind}, {GROWN}"), "trees-grown")
    scored = grown.filter("kind = 'row'").select("grp", "row_id", "forest_pred", "boost_pred")
    shares = grown.filter("kind = 'importance'").select("grp", "feature", "importance")
    if not large.isEmpty():
        wide_rows, wide_shares = _train_wide(data.join(F.broadcast(large.select("grp")), "grp"), rounds, trees, len(cols))
        scored, shares = scored.unionByName(wide_rows), shares.unionByName(wide_shares)
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("feature") + 1)
    return (scored.withColumnRenamed("grp", group),
            shares.select(F.col("grp").alias(group), names.alias("feature"), "importance"))


def _train_wide(data: DataFrame, rounds: int, trees: int, n_cols: int) -> tuple[DataFrame, DataFrame]:
    """The large groups, one job per level: rows are written once a round."""
    h = F.col("is_train").cast("double")
    mean = data.groupBy("grp").agg(F.coalesce(F.sum(F.col("label") * h) / F.nullif(F.sum(h), F.lit(0.0)), F.lit(0.0)).alias("margin"))
    now = write_table(data.join(mean, "grp"), "trees-margin")
    for _ in range(rounds):
        with_g = now.withColumns({"g": (F.col("margin") - F.col("label")) * h, "h": h})
        grown, _ = grow(with_g, ["grp"], BOOST_DEPTH, REGULARISATION, "trees-boost")
        now = write_table(grown.withColumn("margin", F.col("margin") + BOOST_RATE * F.coalesce("value", F.lit(0.0))).select(now.columns), "trees-margin")
    boosted = now.select("grp", "row_id", F.col("margin").alias("boost_pred"))

    votes, shares = [], []
    for first in range(0, trees, 10):       # ten trees at a time bound the replication
        tree = F.explode(F.sequence(F.lit(first), F.lit(min(first + 10, trees) - 1))).alias("tree")
        rows = data.select("*", tree)
        weight = bootstrap_count(F.col("row_id"), F.col("tree")) * h
        grown, splits = grow(rows.withColumns({"h": weight, "g": -F.col("label") * weight}), ["grp", "tree"],
                             FOREST_DEPTH, 0.0, "trees-forest")
        votes.append(write_table(grown.groupBy("grp", "row_id").agg(
            F.sum("value").alias("vote"), F.count("value").alias("used")), "trees-votes"))
        shares.append(splits.groupBy("grp", "tree", "feature").agg(F.sum("gain").alias("gain")))
    forest = reduce(DataFrame.unionByName, votes).groupBy("grp", "row_id").agg(
        F.coalesce(F.sum("vote") / F.nullif(F.sum("used"), F.lit(0)), F.lit(0.0)).alias("forest_pred"))
    share = reduce(DataFrame.unionByName, shares)
    of_tree = share.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("grp", "tree")))
    of_grp = of_tree.groupBy("grp", "feature").agg(F.sum("share").alias("share"))
    every = data.select("grp").distinct().withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))))
    filled = every.join(of_grp, ["grp", "feature"], "left").fillna(0.0, ["share"])
    total = F.sum("share").over(Window.partitionBy("grp"))
    importance = filled.select("grp", "feature", F.when(total > 0, F.col("share") / total).otherwise(0.0).alias("importance"))
    return boosted.join(forest, ["grp", "row_id"]).select("grp", "row_id", "forest_pred", "boost_pred"), importance
