"""Row-order operators over production series.

The reference's order-dependent steps (rolling means, lags, tail, splits)
run over one global, row-ordered frame. Here they run per series (machine,
or tenant + machine); a constant series column reproduces the global form.

Skew-safe layout. A plain ``Window.partitionBy(series)`` moves and sorts the
rows once, but sorts a whole series in one task, so a machine holding a third
of all rows would pin a third of the data to one executor. It therefore serves
the series of at most ``HOT_BLOCK_ROWS`` rows. The rows of longer ones are
windowed inside
*blocks* -- (series, production_date) by default, contiguous runs of the
series order -- and only a bounded *halo* crosses block boundaries: the
last ``k`` rows of each block (a per-group aggregate of at most ``k``
elements), chained over the small one-row-per-block summary. The summary
also carries block offsets, giving exact global positions without a
series-wide sort.

A block with more than ``HOT_BLOCK_ROWS`` rows (a machine-day of a machine that
holds a third of all rows) is cut into sub-blocks by quantiles of the next
order column. Rows with a null series or date key form blocks of their own and
come through every operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import AsOf, as_of_col, safe_div

DEFAULT_BLOCK = ["production_date"]
#: most rows of a series, or of a block, that one task puts in order
HOT_BLOCK_ROWS = 5_000_000
#: most sub-blocks of a hot block
SUB_BLOCKS = 256
#: longest trailing window whose mean is taken from lags; a sliding frame is
#: summed anew for every row, which takes more time than a few lags
LAGGED = 4


def _cols(names):
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls match each other."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def _by_length(df: DataFrame, series: list[str], whole: Callable[[DataFrame], DataFrame],
               blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` over the series of at most ``HOT_BLOCK_ROWS`` rows, ``blocks``
    over the rows of longer ones."""
    long = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_sn")).filter(F.col("_sn") > HOT_BLOCK_ROWS).select(*series)
    if long.isEmpty():
        return whole(df)
    long = write_table(long, "long-series")
    return whole(_join_keys(df, long, series, "left_anti")).unionByName(
        blocks(_join_keys(df, long, series, "left_semi")))


def split_hot_blocks(df: DataFrame, series: list[str], block: list[str], order: list[str],
                     limit: int | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(df, block, order) with hot blocks cut along the next order column.

    Rows with equal values of that column stay together, so sub-blocks are
    contiguous runs of the series order and every result is the same.
    """
    limit = HOT_BLOCK_ROWS if limit is None else limit
    rest = order[len(block):]
    if not rest:
        return df, block, order
    keys = series + block
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn")).filter(F.col("_bn") > limit).select(*keys)
    if hot.isEmpty():
        return df, block, order
    steps = [i / SUB_BLOCKS for i in range(1, SUB_BLOCKS)]
    cuts = (_join_keys(df.select(*keys, rest[0]), hot, keys, "left_semi").groupBy(*keys)
            .agg(F.array_distinct(F.percentile_approx(rest[0], steps)).alias("_cuts")))
    sub = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(rest[0]))), F.lit(0))
    out = _join_keys(df, cuts, keys, "left").withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(sub)).drop("_cuts")
    return out, [*block, "_sub"], [*block, "_sub", *rest]


def _block_summary(df: DataFrame, series: list[str], block: list[str]) -> DataFrame:
    """One row per block: global offset and series length, from a partial
    aggregate of block row counts over the source (no sort of the rows)."""
    keys = series + block
    ws = Window.partitionBy(*series).orderBy(*block)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn"))
            .withColumn("_off", F.coalesce(
                F.sum("_bn").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*series)))
            .select(*keys, "_off", "_n"))


def with_history(df: DataFrame, series: list[str], order: list[str], values: list[str],
                 k: int, block: list[str] | None = None) -> DataFrame:
    """Add ``<v>_prev`` (up to ``k`` previous values, oldest first) for each
    value column, plus ``_pos`` (1-based position in the series) and ``_n``
    (series length).

    ``order`` must start with the ``block`` columns (rows of a block are
    contiguous in series order). The block tails are read off the windowed
    rows (their last ``k`` rows per block); measured faster than a separate
    top-k group limit over the source, which sorts every row a second time.
    """
    block = list(DEFAULT_BLOCK if block is None else block)
    assert order[:len(block)] == block, "series order must start with the block columns"
    return _by_length(df, series, lambda d: _whole_history(d, series, order, values, k),
                      lambda d: _block_history(d, series, order, values, k, block))


def _whole_history(df: DataFrame, series: list[str], order: list[str], values: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*series).orderBy(*_cols(order))
    out = {"_n": F.count(F.lit(1)).over(_all(w)), "_pos": F.row_number().over(w).cast("long")}
    for v in values:
        held = F.collect_list(F.struct(F.col(v).alias("x"))).over(w.rowsBetween(-k, -1))
        out[f"{v}_prev"] = F.transform(held, lambda s: s["x"])
    return df.withColumns(out)


def _all(w):
    """The whole partition as a frame of the ordered window: no second sort."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _block_history(df: DataFrame, series: list[str], order: list[str], values: list[str],
                   k: int, block: list[str]) -> DataFrame:
    df, block, order = split_hot_blocks(df, series, block, order)
    in_block = order[len(block):] or order
    keys = series + block
    wb = Window.partitionBy(*keys).orderBy(*_cols(in_block))
    local = (df
             .withColumn("_rn", F.row_number().over(wb))
             # structs keep null values in place (collect_list drops bare nulls)
             .withColumns({f"_{v}_local": F.transform(
                 F.collect_list(F.struct(F.col(v).alias("x"))).over(wb.rowsBetween(-k, -1)),
                 lambda s: s["x"]) for v in values})
             .withColumn("_bn", F.count(F.lit(1)).over(Window.partitionBy(*keys))))

    # last k rows of every block -> one row per block (bounded arrays)
    tails = (local.filter(F.col("_rn") > F.col("_bn") - k)
             .groupBy(*keys)
             .agg(F.first("_bn").alias("_bn"),
                  F.array_sort(F.collect_list(F.struct("_rn", *values))).alias("_tail")))
    ws = Window.partitionBy(*series).orderBy(*block)
    summary = (tails
               .withColumn("_off", F.coalesce(
                   F.sum("_bn").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*series)))
               .withColumn("_halo", F.flatten(F.collect_list("_tail").over(ws.rowsBetween(-k, -1))))
               .select(*keys, "_off", "_n", "_halo"))

    joined = _join_keys(local, summary, keys)
    out = {}
    for v in values:
        loc = F.col(f"_{v}_local")
        full = F.concat(F.transform(F.col("_halo"), _field(v)), loc)
        size = F.size(full)
        out[f"{v}_prev"] = F.when(F.col("_rn") > k, loc).otherwise(
            F.slice(full, F.greatest(size - k + 1, F.lit(1)), k))
    out["_pos"] = F.col("_off") + F.col("_rn")
    drop = ["_rn", "_bn", "_off", "_halo", "_sub"] + [f"_{v}_local" for v in values]
    return joined.withColumns(out).drop(*drop)


def _field(name: str):
    return lambda x: x[name]


def _sum_last(arr: Column, m: int) -> tuple[Column, Column]:
    """Sum and non-null count of the last ``m`` entries of ``arr``."""
    tail = F.slice(arr, F.greatest(F.size(arr) - m + 1, F.lit(1)), m)
    s = F.aggregate(tail, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    n = F.size(F.filter(tail, lambda x: x.isNotNull()))
    return s, n


def trailing_means(df: DataFrame, series: list[str], order: list[str],
                   specs: dict[str, str], window: int,
                   block: list[str] | None = None, min_rows: int | None = None) -> DataFrame:
    """W1/W2 ``rolling(window, min_periods=1).mean()`` per series.

    ``specs`` maps output column -> value column. With ``min_rows`` a series
    shorter than that keeps the raw value (the reference's < 5 rows rule).
    (Measured against an in-block sum/count formulation with halo patching:
    the bounded history arrays are faster.)
    """
    values = sorted(set(specs.values()))
    block = list(DEFAULT_BLOCK if block is None else block)
    assert order[:len(block)] == block, "series order must start with the block columns"

    def means(of, n) -> dict[str, Column]:
        out = {}
        for out_col, v in specs.items():
            out[out_col] = F.when(n < min_rows, F.col(v).cast("double")).otherwise(of(v)) if min_rows else of(v)
        return out

    def whole(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(*series).orderBy(*_cols(order))
        last = w.rowsBetween(1 - window, Window.currentRow)

        def mean(v: str) -> Column:
            x = F.col(v).cast("double")
            if window > LAGGED:
                return F.avg(x).over(last)
            held = [F.lag(x, j).over(w) for j in range(window - 1, 0, -1)] + [x]
            s, n = F.lit(0.0), F.lit(0)
            for h in held:  # oldest first, as avg adds
                s, n = s + F.coalesce(h, F.lit(0.0)), n + F.when(h.isNull(), 0).otherwise(1)
            return safe_div(s, n)
        return d.withColumns(means(mean, F.count(F.lit(1)).over(_all(w))))

    def in_blocks(d: DataFrame) -> DataFrame:
        def mean(v: str) -> Column:
            s, n = _sum_last(F.col(f"{v}_prev"), window - 1)
            cur = F.col(v).cast("double")
            return safe_div(s + F.coalesce(cur, F.lit(0.0)), n + F.when(cur.isNull(), 0).otherwise(1))
        h = _block_history(d, series, order, values, window - 1, block)
        return h.withColumns(means(mean, F.col("_n"))).drop(*[f"{v}_prev" for v in values], "_n", "_pos")

    return _by_length(df, series, whole, in_blocks)


def lag_features(df: DataFrame, series: list[str], order: list[str], value: str,
                 lags: int = 10, block: list[str] | None = None,
                 keep_partial: bool = False) -> DataFrame:
    """W3 supervised sequences: ``lag_1 .. lag_n`` -> ``target`` (= value).

    Without ``keep_partial`` only rows with a full history are kept. (One
    bounded history array beats ``lags`` separate ``lag`` window functions.)
    """
    h = with_history(df, series, order, [value], lags, block)
    prev = F.col(f"{value}_prev")
    out = h.withColumns({f"lag_{j}": F.when(F.size(prev) >= j,
                                            F.try_element_at(prev, F.lit(-j)))
                         for j in range(1, lags + 1)})
    if not keep_partial:
        out = out.filter(F.col("_pos") > lags)
    return out.withColumnRenamed("_pos", "seq_pos").drop(f"{value}_prev", "_n")


def positions(df: DataFrame, series: list[str], order: list[str],
              block: list[str] | None = None) -> DataFrame:
    """Global 1-based ``pos`` and series length ``n``; no sort of a long series."""
    block = list(DEFAULT_BLOCK if block is None else block)
    w = Window.partitionBy(*series).orderBy(*_cols(order))
    return _by_length(df, series, lambda d: d.withColumns({
        "n": F.count(F.lit(1)).over(_all(w)), "pos": F.row_number().over(w).cast("long")}),
        lambda d: _block_positions(d, series, order, block))


def _block_positions(df: DataFrame, series: list[str], order: list[str], block: list[str]) -> DataFrame:
    df, block, order = split_hot_blocks(df, series, block, order)
    keys = series + block
    in_block = order[len(block):] or order
    wb = Window.partitionBy(*keys).orderBy(*_cols(in_block))
    local = df.withColumn("_rn", F.row_number().over(wb))
    summary = _block_summary(df, series, block)
    return (_join_keys(local, summary, keys)
            .withColumn("pos", F.col("_off") + F.col("_rn"))
            .withColumnRenamed("_n", "n").drop("_off", "_rn", "_sub"))


def last_n(df: DataFrame, series: list[str], order: list[str], n: int) -> DataFrame:
    """W4 ``tail(n)`` per series, returned in ascending order with ``tail_rank``.

    ``row_number() <= n`` over a descending order is planned as a group limit
    (a partial top-n on the map side), so a hot series ships n rows per
    input partition, not the whole series.
    """
    w = Window.partitionBy(*series).orderBy(*[F.col(c).desc() for c in order])
    return (df.withColumn("tail_rank", F.row_number().over(w))
            .filter(F.col("tail_rank") <= n))


def chrono_split(df: DataFrame, series: list[str], order: list[str], frac: float = 0.8,
                 block: list[str] | None = None) -> DataFrame:
    """W5 chronological split: first ``int(frac * n)`` rows are ``train``."""
    p = positions(df, series, order, block)
    return p.withColumn("is_train", F.col("pos") <= F.floor(F.col("n") * F.lit(frac)))


def row_index(df: DataFrame, series: list[str], order: list[str],
              block: list[str] | None = None) -> DataFrame:
    """W6 ``reset_index()``: 0-based sequence number per series."""
    p = positions(df, series, order, block)
    return p.withColumn("row_index", F.col("pos") - 1).drop("pos", "n")


def synthesized_dates(df: DataFrame, series: list[str], order: list[str],
                      as_of: AsOf = None, block: list[str] | None = None) -> DataFrame:
    """W7 daily dates ending at ``as_of`` when the data has no date column."""
    p = positions(df, series, order, block)
    return p.withColumn("ds", F.date_add(as_of_col(as_of), (F.col("pos") - F.col("n")).cast("int")))


def latest_reading(df: DataFrame, keys: list[str], order: list[str],
                   cols: list[str]) -> DataFrame:
    """W8 latest reading per machine: ``max_by(struct, struct(order))``.

    An aggregate (partial per partition, then final), so a chatty machine
    costs one partial row per input partition.
    """
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*order, *cols), F.struct(*order)).alias("_v"))
            .select(*keys, *[F.col("_v")[c].alias(c) for c in order + cols]))


def sample_gate(df: DataFrame, series: list[str], min_rows: int) -> DataFrame:
    """P14 per-series sample count and whether it reaches ``min_rows``."""
    return (df.groupBy(*series).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("enough", F.col("n_rows") >= min_rows))
