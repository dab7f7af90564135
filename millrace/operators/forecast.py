"""Per-series forecasting.

Series are daily: rows are first reduced to one value per (series, day)
(an aggregate), so a busy machine contributes one row per day no matter how
many records it has. Model state per series is tiny (10 AR coefficients, a
slope, an intercept, 7 weekday effects), so fits are grouped aggregates solved
by array folds; only the changepoint model is a grouped numpy solve, over at
most one row per day of history.

Three models replace the reference's neural network and Prophet models:
* ``ar``: linear autoregression on the 10 previous min-max scaled values
  (same lookback, split and sample gates as the LSTM it replaces), rolled
  forward recursively with a higher-order ``aggregate`` fold;
* ``trend_weekday``: least-squares linear trend plus the mean weekday
  residual (a Prophet-like trend + weekly seasonality without changepoints);
* ``trend_changepoint``: piecewise-linear trend (25 changepoints) + weekly
  Fourier terms; changes of trend have a Laplace prior, so most are exactly
  zero, and bands widen by simulated changes to come.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from . import windows

LOOKBACK = 10
HORIZON = 7
Z95 = 1.96          # band of the recursive forecast: +-1.96 sample std of history
Z80 = 1.2815515655  # band of the trend model: 80 % normal interval of residuals
MIN_AR_ROWS = 20    # and at least LOOKBACK + 5
MIN_TREND_ROWS = 10


def daily_series(df: DataFrame, series: list[str], value: str = "downtime_min",
                 date_col: str = "production_date") -> DataFrame:
    """One value per (series, day): the mean of that day's rows."""
    return (df.groupBy(*series, date_col)
            .agg(F.avg(value).alias("y"), F.count(F.lit(1)).alias("n_rows")))


def minmax(df: DataFrame, series: list[str], col: str = "y") -> DataFrame:
    """M15 per-series min-max scaling to [0, 1] (constant series -> 0)."""
    w = Window.partitionBy(*series)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return (df.withColumn("y_min", lo).withColumn("y_max", hi)
            .withColumn("y_scaled", F.when(F.col("y_max") > F.col("y_min"),
                                           (F.col(col) - F.col("y_min")) /
                                           (F.col("y_max") - F.col("y_min")))
                        .otherwise(F.lit(0.0))))


def unscale(c: Column) -> Column:
    """M15 inverse transform with the series' min and max."""
    return c * (F.col("y_max") - F.col("y_min")) + F.col("y_min")


# --------------------------------------------------------------------------
# trend + weekday tier (M19a, M22) and the future frame
# --------------------------------------------------------------------------

def _t(date_col: str = "production_date") -> Column:
    return F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")).cast("double")


def trend_fit(daily: DataFrame, series: list[str], weekly: bool = True,
              date_col: str = "production_date") -> DataFrame:
    """M22/M19a per-series slope, intercept, residual std and weekday effects."""
    d = daily.withColumn("t", _t(date_col))
    lin = d.groupBy(*series).agg(
        F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"),
        F.count(F.lit(1)).alias("n_days"), F.max(date_col).alias("last_date"),
        F.stddev_samp("y").alias("y_std"))
    if not weekly:
        return lin
    res = (d.join(lin, series)
           .withColumn("resid", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t")))
           .withColumn("dow", F.dayofweek(date_col)))
    effects = (res.groupBy(*series, "dow").agg(F.avg("resid").alias("effect")))
    spread = res.groupBy(*series).agg(F.stddev_samp("resid").alias("resid_std"))
    packed = (effects.groupBy(*series)
              .agg(F.map_from_entries(F.collect_list(F.struct("dow", "effect"))).alias("weekday")))
    return lin.join(spread, series, "left").join(packed, series, "left")


def future_frame(fit: DataFrame, series: list[str], horizon: int = HORIZON) -> DataFrame:
    """M20 the next ``horizon`` days after each series' last date."""
    return fit.select(*series, F.posexplode(F.sequence(
        F.date_add("last_date", 1), F.date_add("last_date", horizon))).alias("pos", "ds")) \
        .select(*series, (F.col("pos") + 1).alias("step"), "ds")


def trend_forecast(daily: DataFrame, series: list[str], horizon: int = HORIZON,
                   weekly: bool = True, date_col: str = "production_date",
                   include_history: bool = True) -> DataFrame:
    """M19a/M20 fitted history + future rows: (series, ds, step, yhat, lower, upper).

    ``step`` is 0 for fitted history rows and 1..horizon for future days.
    Series below the 10-day gate get no forecast.
    """
    fit = trend_fit(daily, series, weekly, date_col).filter(F.col("n_days") >= MIN_TREND_ROWS)
    fut = future_frame(fit, series, horizon)
    parts = [fut]
    if include_history:
        parts.append(daily.select(*series, F.col(date_col).alias("ds"),
                                  F.lit(0).alias("step")))
    frame = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    t = F.datediff(F.col("ds"), F.lit("1970-01-01").cast("date")).cast("double")
    base = F.col("intercept") + F.col("slope") * t
    if weekly:
        base = base + F.coalesce(F.element_at(F.col("weekday"), F.dayofweek("ds")), F.lit(0.0))
        half = F.coalesce(F.col("resid_std"), F.lit(0.0)) * Z80
    else:
        half = F.coalesce(F.col("y_std"), F.lit(0.0)) * Z80
    return (frame.join(fit, series, "inner")
            .select(*series, "ds", "step", base.alias("yhat"),
                    (base - half).alias("lower"), (base + half).alias("upper")))


# --------------------------------------------------------------------------
# autoregressive tier
# --------------------------------------------------------------------------

def ar_training_rows(daily: DataFrame, series: list[str], lookback: int = LOOKBACK,
                     date_col: str = "production_date") -> DataFrame:
    """W3 + W5 on the scaled daily series: lags -> target, with is_train.

    A daily series holds one row per day, so one window over the series does.
    """
    w = Window.partitionBy(*series).orderBy(date_col)
    lags = (minmax(daily, series)
            .withColumns({f"lag_{j}": F.lag("y_scaled", j).over(w) for j in range(1, lookback + 1)})
            .withColumn("seq_pos", F.row_number().over(w))
            .withColumn("n_seq", F.count(F.lit(1)).over(Window.partitionBy(*series)) - lookback)
            .filter(F.col("seq_pos") > lookback))
    return lags.withColumn("is_train", (F.col("seq_pos") - lookback) <=
                           F.floor(F.col("n_seq") * F.lit(0.8)))


def normal_equations(rows: DataFrame, series: list[str], lookback: int = LOOKBACK) -> DataFrame:
    """(series, m, n_train): the augmented matrix [X'X | X'y] of each series.

    X is 1 and the lags, oldest first. Every entry is a sum, so a series is
    combined map-side; a series too short for the 80 % split uses all its rows.
    """
    x = ["_one"] + [f"lag_{j}" for j in range(lookback, 0, -1)] + ["y_scaled"]
    used = rows.withColumn("_one", F.lit(1.0)).filter(
        F.col("is_train") | (F.floor(F.col("n_seq") * F.lit(0.8)) < 1))
    pairs = [(i, j) for i in range(lookback + 1) for j in range(i, lookback + 2)]
    sums = used.groupBy(*series).agg(F.count(F.lit(1)).cast("int").alias("n_train"),
                                     *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"_s{i}_{j}") for i, j in pairs])
    m = F.array(*[F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(lookback + 2)])
                  for i in range(lookback + 1)])
    return sums.select(*series, m.alias("m"), "n_train")


def solve_rows(m: Column, size: int) -> Column:
    """Solution of a positive definite system given as rows [A | b]: a fold of
    Gauss-Jordan steps (no pivoting is needed for such a matrix)."""
    def clear(acc: Column, k: Column) -> Column:
        pivot = F.get(acc, k)
        return F.transform(acc, lambda row, i: F.when(i == k, row).otherwise(F.zip_with(
            row, pivot, lambda a, p: a - p * (F.get(row, k) / F.get(pivot, k)))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), m, clear)
    return F.transform(done, lambda row, i: F.get(row, F.lit(size)) / F.get(row, i))


def fit_ar(daily: DataFrame, series: list[str], lookback: int = LOOKBACK,
           ridge: float = 1e-6, date_col: str = "production_date") -> DataFrame:
    """M16 per-series least squares AR(lookback) on the training 80 %.

    The normal equations are one aggregate, the (lookback + 1)-square system
    of a series is solved by an array fold. The intercept carries no ridge.
    """
    eq = normal_equations(ar_training_rows(daily, series, lookback, date_col), series, lookback)
    ridged = F.transform("m", lambda row, i: F.transform(row, lambda v, j: F.when(
        (i == j) & (i > 0), v + F.lit(ridge)).otherwise(v)))
    return (eq.withColumn("_b", solve_rows(ridged, lookback + 1))
            .select(*series, F.get("_b", F.lit(0)).alias("intercept"),
                    F.slice("_b", 2, lookback).alias("coef"), "n_train"))


def ar_state(daily: DataFrame, series: list[str], lookback: int = LOOKBACK,
             date_col: str = "production_date") -> DataFrame:
    """Last ``lookback`` scaled values (oldest first) + scaling + history std.

    The last rows per series come from a group limit (W4), not a full sort.
    """
    scaled = minmax(daily, series)
    tail = windows.last_n(scaled, series, [date_col], lookback)
    return (tail.groupBy(*series)
            .agg(F.array_sort(F.collect_list(F.struct(date_col, "y_scaled"))).alias("_t"),
                 F.first("y_min").alias("y_min"), F.first("y_max").alias("y_max"),
                 F.max(date_col).alias("last_date"))
            .withColumn("hist", F.transform("_t", lambda s: s["y_scaled"])).drop("_t"))


def recursive_forecast(state: DataFrame, coefs: DataFrame, series: list[str],
                       horizon: int = HORIZON, lookback: int = LOOKBACK) -> DataFrame:
    """M17 roll the AR model forward ``horizon`` steps (append, slide).

    A single ``aggregate`` fold per series: the accumulator carries the
    sliding window and the predictions so far. Output is scaled back (M15).
    """
    j = state.join(coefs, series, "inner").filter(F.size("hist") == lookback)
    init = F.struct(F.col("hist").alias("w"), F.array().cast("array<double>").alias("p"))

    def step(acc, _i):
        nxt = F.aggregate(F.arrays_zip(F.col("coef").alias("c"), acc["w"].alias("x")),
                          F.col("intercept"), lambda a, z: a + z["c"] * z["x"])
        return F.struct(F.concat(F.slice(acc["w"], 2, lookback - 1), F.array(nxt)).alias("w"),
                        F.concat(acc["p"], F.array(nxt)).alias("p"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)
    return (j.select(*series, "y_min", "y_max", "last_date",
                     F.posexplode(folded["p"]).alias("pos", "yhat_scaled"))
            .select(*series, (F.col("pos") + 1).alias("step"),
                    F.date_add("last_date", F.col("pos") + 1).alias("ds"),
                    unscale(F.col("yhat_scaled")).alias("yhat")))


def with_history_band(fc: DataFrame, daily: DataFrame, series: list[str],
                      z: float = Z95) -> DataFrame:
    """M18 +- z x sample std of the (unscaled) history (A10)."""
    sd = daily.groupBy(*series).agg(F.stddev_samp("y").alias("_sd"))
    return (fc.join(sd, series, "left")
            .withColumn("lower", F.col("yhat") - z * F.col("_sd"))
            .withColumn("upper", F.col("yhat") + z * F.col("_sd")).drop("_sd"))


def ensemble(a: DataFrame, b: DataFrame, series: list[str]) -> DataFrame:
    """M21 mean of two forecasts per (series, step); absent if either is."""
    return (a.select(*series, "step", "ds", F.col("yhat").alias("_a"))
            .join(b.select(*series, "step", F.col("yhat").alias("_b")), series + ["step"])
            .select(*series, "step", "ds", ((F.col("_a") + F.col("_b")) / 2).alias("yhat")))


def rollup(fc: DataFrame, series: list[str]) -> DataFrame:
    """A13 first forecast value and the mean over the horizon."""
    return fc.groupBy(*series).agg(F.min_by("yhat", "step").alias("next_period"),
                                   F.avg("yhat").alias("horizon_avg"))


def forecast_all(df: DataFrame, series: list[str], value: str = "downtime_min",
                 horizon: int = HORIZON, date_col: str = "production_date") -> DataFrame:
    """M23 long result (series, step, ds, model, yhat, lower, upper)."""
    daily = write_table(daily_series(df, series, value, date_col), "m23-daily")
    gate = daily.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    ar_ok = gate.filter(F.col("_n") >= max(MIN_AR_ROWS, LOOKBACK + 5)).select(*series)
    coefs = fit_ar(daily.join(ar_ok, series, "left_semi"), series, date_col=date_col)
    ar = with_history_band(
        recursive_forecast(ar_state(daily, series, date_col=date_col), coefs, series, horizon),
        daily, series)
    tw = trend_forecast(daily, series, horizon, True, date_col, include_history=False)
    ens = ensemble(ar, tw, series)
    cols = [*series, "step", "ds", "model", "yhat", "lower", "upper"]
    return (ar.withColumn("model", F.lit("ar")).select(*cols)
            .unionByName(tw.withColumn("model", F.lit("trend_weekday")).select(*cols))
            .unionByName(ens.withColumn("model", F.lit("ensemble"))
                         .withColumn("lower", F.lit(None).cast("double"))
                         .withColumn("upper", F.lit(None).cast("double")).select(*cols)))


# --------------------------------------------------------------------------
# M19 (b): piecewise-linear trend + weekly Fourier seasonality per series
# --------------------------------------------------------------------------

# The reference model's priors and the public defaults of the
# model family it uses (25 changepoints over the first 80 % of history,
# weekly Fourier order 3, 80 % interval).
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
WEEKLY_ORDER = 3


TREND_DRAWS = 1000   # simulated futures behind a band
SCHEMA_FIT = ("n_days long, first_date date, last_date date, span double, scale double, noise double, "
              "changepoints array<double>, trend array<double>, deltas array<double>, weekly array<double>, "
              "resid_sd double, dev_lower array<double>, dev_upper array<double>")


def _design(t: np.ndarray, cps: np.ndarray, days: np.ndarray) -> np.ndarray:
    cols = [np.ones_like(t), t]
    for n in range(1, WEEKLY_ORDER + 1):
        ang = 2 * np.pi * n * days / 7.0
        cols += [np.sin(ang), np.cos(ang)]
    cols += [np.maximum(t - c, 0.0) for c in cps]
    return np.column_stack(cols)


def sparse_solve(s: np.ndarray, c: np.ndarray, lam: float) -> np.ndarray:
    """Minimiser of x's x / 2 - c'x + lam |x|_1 by feature-sign search.

    A zero coefficient whose gradient exceeds ``lam`` joins with that sign, the
    signed system is solved, and the best point up to the first sign changes is
    taken: every step lowers the objective, and zeros are exact.
    """
    x = np.zeros(len(c))
    tol = 1e-9 * max(lam, float(np.abs(c).max(initial=0.0)), 1e-12)

    def cost(v):
        return 0.5 * v @ s @ v - c @ v + lam * np.abs(v).sum()

    for _ in range(40 * len(c)):
        g = s @ x - c
        sign = np.sign(x)
        if np.all(np.abs(g + lam * sign)[sign != 0] <= tol):
            excess = np.where(sign == 0, np.abs(g) - lam, -np.inf)
            if excess.size == 0 or excess.max() <= tol:
                break
            j = int(excess.argmax())
            sign[j] = -np.sign(g[j])
        act = np.flatnonzero(sign)
        new = np.zeros_like(x)
        new[act] = np.linalg.solve(s[np.ix_(act, act)], c[act] - lam * sign[act])
        flips = [k for k in act if x[k] != 0 and x[k] * new[k] < 0]
        tries = [new]
        for k in flips:
            at = x + (x[k] / (x[k] - new[k])) * (new - x)
            at[k] = 0.0
            tries.append(at)
        x = min(tries, key=cost)
    return x


def _fit_changepoints(days: np.ndarray, y: np.ndarray):
    """Most probable trend, changes and weekly terms of one series (days from 0)."""
    span, scale = max(days[-1], 1.0), max(np.abs(y).max(), 1e-12)
    t, ys = days / span, y / scale
    hist_days = days[: max(int(len(days) * CHANGEPOINT_RANGE), 1)]
    n_cp = min(N_CHANGEPOINTS, max(len(hist_days) - 1, 0))
    cps = np.quantile(hist_days, np.linspace(0, 1, n_cp + 2)[1:-1]) / span if n_cp else np.array([])
    x = _design(t, cps, days)
    free = 2 + 2 * WEEKLY_ORDER
    gram, xy = x.T @ x, x.T @ ys
    beta0, *_ = np.linalg.lstsq(x[:, :free], ys, rcond=None)
    s2 = max(float(np.mean((ys - x[:, :free] @ beta0) ** 2)), 1e-8)
    for _ in range(20):      # noise and coefficients in turn; a fit belongs to the noise before it
        pen = np.r_[np.full(2, 1e-9), np.full(2 * WEEKLY_ORDER, s2 / SEASONALITY_PRIOR ** 2)]
        inner = gram[:free, :free] + np.diag(pen)
        lift = np.linalg.solve(inner, np.column_stack([gram[:free, free:], xy[:free]]))
        s = gram[free:, free:] - gram[free:, :free] @ lift[:, :-1]
        s[np.diag_indices_from(s)] += 1e-9
        delta = sparse_solve(s, xy[free:] - gram[free:, :free] @ lift[:, -1], s2 / CHANGEPOINT_PRIOR)
        beta = np.r_[lift[:, -1] - lift[:, :-1] @ delta, delta]
        now = max(float(np.mean((ys - x @ beta) ** 2)), 1e-8)
        if abs(now - s2) <= 1e-3 * s2:
            break
        used, s2 = s2, now
    else:
        s2 = used
    return span, scale, s2, cps, beta, ys - x @ beta


def _changepoint_model(series: list[str], horizon: int):
    free = 2 + 2 * WEEKLY_ORDER

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        dates = pdf["ds"].to_numpy("datetime64[D]")
        days = (dates - dates[0]).astype("float64")
        span, scale, s2, cps, beta, resid = _fit_changepoints(days, pdf["y"].to_numpy(dtype="float64"))
        sd = float(np.std(resid, ddof=1)) if len(resid) > 1 else 0.0
        # futures: changes come at the history's rate, as large as those found
        rng = np.random.default_rng(zlib.crc32("\x1f".join(str(pdf[k].iloc[0]) for k in series).encode()))
        ahead = np.arange(1, horizon + 1) / span
        n_new = rng.poisson(len(cps) * ahead[-1], TREND_DRAWS)
        size = (float(np.abs(beta[free:]).mean()) if len(cps) else 0.0) + 1e-8
        dev = rng.normal(0.0, sd, (TREND_DRAWS, horizon))
        for k in range(int(n_new.max(initial=0))):
            at = rng.uniform(0.0, ahead[-1], TREND_DRAWS)[:, None]
            change = np.where(n_new > k, rng.laplace(0.0, size, TREND_DRAWS), 0.0)[:, None]
            dev += change * np.maximum(ahead[None, :] - at, 0.0)
        lower, upper = np.quantile(dev * scale, [0.1, 0.9], axis=0)
        row = {k: pdf[k].iloc[0] for k in series} | {
            "n_days": len(days), "first_date": pdf["ds"].iloc[0], "last_date": pdf["ds"].iloc[-1],
            "span": span, "scale": scale, "noise": s2, "changepoints": cps.tolist(),
            "trend": beta[:2].tolist(), "deltas": beta[free:].tolist(), "weekly": beta[2:free].tolist(),
            "resid_sd": sd * scale, "dev_lower": lower.tolist(), "dev_upper": upper.tolist()}
        return pd.DataFrame([row])
    return fit


def changepoint_fits(daily: DataFrame, series: list[str], horizon: int = HORIZON,
                     date_col: str = "production_date") -> DataFrame:
    """M19b one row of coefficients per series of at least 10 days.

    Coefficients are for y / ``scale`` over t = days / ``span``; ``noise`` is the
    variance the penalties were weighed with. ``dev_lower`` and ``dev_upper`` are
    the band around each future day, from ``TREND_DRAWS`` futures drawn with a
    seed of the series' name.
    """
    gate = daily.groupBy(*series).agg(F.count(F.lit(1)).alias("_n")) \
                .filter(F.col("_n") >= MIN_TREND_ROWS).drop("_n")
    src = (daily.join(gate, series, "left_semi")
           .select(*[F.col(s).cast("string") for s in series],
                   F.col(date_col).alias("ds"), F.col("y").cast("double")))
    schema = ", ".join(f"{s} string" for s in series) + ", " + SCHEMA_FIT
    return src.groupBy(*series).applyInPandas(_changepoint_model(series, horizon), schema)


def changepoint_value(ds: Column) -> Column:
    """The fitted value of a day, from the columns of ``changepoint_fits``."""
    day = F.datediff(ds, F.col("first_date")).cast("double")
    t = day / F.col("span")
    value = F.get("trend", F.lit(0)) + F.get("trend", F.lit(1)) * t
    value = value + F.aggregate(F.zip_with("changepoints", "deltas", lambda c, d: d * F.greatest(t - c, F.lit(0.0))),
                                F.lit(0.0), lambda a, v: a + v)
    for n in range(1, WEEKLY_ORDER + 1):
        ang = day * (2 * np.pi * n / 7.0)
        value = value + F.get("weekly", F.lit(2 * n - 2)) * F.sin(ang) + F.get("weekly", F.lit(2 * n - 1)) * F.cos(ang)
    return value * F.col("scale")


def changepoint_forecast(daily: DataFrame, series: list[str], horizon: int = HORIZON,
                         date_col: str = "production_date") -> DataFrame:
    """M19b/M20 fitted history + ``horizon`` future days per series.

    One grouped numpy fit per series over at most one row per day of history
    (``changepoint_fits``); values follow from its coefficients by column
    expressions. Series below the 10-day gate get no forecast.
    """
    fits = write_table(changepoint_fits(daily, series, horizon, date_col), "m19b-fits")
    frame = future_frame(fits, series, horizon).unionByName(
        daily.select(*[F.col(s).cast("string") for s in series], F.lit(0).alias("step"), F.col(date_col).alias("ds")))
    yhat, half = changepoint_value(F.col("ds")), F.col("resid_sd") * Z80
    past = F.col("step") == 0
    return (frame.join(fits, series, "inner").select(
        *series, "ds", "step", yhat.alias("yhat"),
        (yhat + F.when(past, -half).otherwise(F.get("dev_lower", F.col("step") - 1))).alias("lower"),
        (yhat + F.when(past, half).otherwise(F.get("dev_upper", F.col("step") - 1))).alias("upper")))


def changepoint_optimality(daily: DataFrame, fits: DataFrame, series: list[str], tol: float = 1e-5,
                           date_col: str = "production_date") -> DataFrame:
    """(series, n_days, n_changepoints, optimal): is each fit a minimum?

    At a minimum of the penalised objective the residuals' product with a
    changepoint's column is ``noise / prior`` with the change's sign, or no
    larger if there is no change; with level and slope it is zero.
    """
    day = F.datediff(F.col(date_col), F.col("first_date")).cast("double")
    r = (daily.select(*[F.col(s).cast("string") for s in series], date_col, "y").join(fits, series)
         .withColumn("_t", day / F.col("span"))
         .withColumn("_r", (F.col("y") - changepoint_value(F.col(date_col))) / F.col("scale")))
    free = r.groupBy(*series).agg(F.first("n_days").alias("n_days"), F.size(F.first("changepoints")).alias("n_changepoints"),
                                  (F.greatest(F.abs(F.sum("_r")), F.abs(F.sum(F.col("_r") * F.col("_t")))) <=
                                   tol * F.first("n_days")).alias("_free"))
    per = (r.select(*series, "noise", "_t", "_r", F.posexplode(F.arrays_zip("changepoints", "deltas")).alias("_j", "_x"))
           .groupBy(*series, "_j").agg(F.sum(F.col("_r") * F.greatest(F.col("_t") - F.col("_x.changepoints"), F.lit(0.0))).alias("_g"),
                                       F.first("_x.deltas").alias("_d"), F.first("noise").alias("_s2")))
    lam = F.col("_s2") / CHANGEPOINT_PRIOR
    held = F.when(F.col("_d") == 0, F.abs("_g") <= lam + tol).otherwise(
        F.abs(F.col("_g") - lam * F.signum("_d")) <= tol)
    bends = per.groupBy(*series).agg(F.bool_and(held).alias("_bends"))
    return free.join(bends, series, "left").select(
        *series, "n_days", "n_changepoints", (F.col("_free") & F.coalesce("_bends", F.lit(True))).alias("optimal"))
