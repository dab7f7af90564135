"""Features, scaling, model, anomaly and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, forecast, ml, trees, windows
from ..operators.common import trailing_window
from ..sources.fixtures import ORDER_COLS
from ..session import write_table
from .catalog import query
from .oracle_views import AS_OF

P = ("production",)
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER_SQL = "production_date, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SERIES = ["machine_id"]
FEATS = list(ml.FEATURES)
NOW = "2001-01-01 00:00:00"   # passed in, so that a run can be repeated
ML_DAYS = 30          # the ML routes' default window


def _features(fx, df=None):
    p = (df if df is not None else fx.production).select(
        *KEYS, "tenant_id", "production_date", "machine_id", "units_produced",
        "defective_units", "downtime_min")
    return ml.features(p, SERIES, ORDER_COLS)


_M1 = f"""
m1 AS (
  SELECT {KEY_SQL}, tenant_id, production_date, machine_id, units_produced, defective_units,
         downtime_min,
         defective_units / (units_produced + 1) AS defect_rate,
         1 - defective_units / (units_produced + 1) AS quality_score,
         units_produced / (downtime_min + 1) AS production_efficiency,
         CASE WHEN COUNT(*) OVER (PARTITION BY machine_id) < 5 THEN units_produced
              ELSE AVG(units_produced) OVER w END AS units_ma3,
         CASE WHEN COUNT(*) OVER (PARTITION BY machine_id) < 5 THEN defective_units
              ELSE AVG(defective_units) OVER w END AS defects_ma3,
         CASE WHEN COUNT(*) OVER (PARTITION BY machine_id) < 5 THEN downtime_min
              ELSE AVG(downtime_min) OVER w END AS downtime_trend
  FROM production
  WINDOW w AS (PARTITION BY machine_id ORDER BY {ORDER_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query("m1_features", f"WITH {_M1.strip()}\nSELECT * FROM m1", P)
def m1_features(fx):
    return _features(fx)


_Z = ",\n       ".join(
    f"({c} - AVG({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END AS {c}_z" for c in FEATS)


@query("m3_standardize", f"WITH {_M1.strip()}\nSELECT {KEY_SQL}, {_Z}\nFROM m1", P)
def m3_standardize(fx):
    # read for the statistics and the scores
    f = write_table(_features(fx).select(*KEYS, *FEATS), "m3-features")
    return ml.standardize(f, FEATS).select(*KEYS, *[f"{c}_z" for c in FEATS])


@query("m2_hash_split", f"""
SELECT {KEY_SQL}, (CAST('0x' || substr(md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8) AS BIGINT) % 100) < 80 AS is_train
FROM production""", P)
def m2_hash_split(fx):
    return ml.hash_split(fx.production.select(*KEYS), KEYS)


@query("s11_model_input", f"""
SELECT production_date AS "Date", units_produced AS "Units Produced", defective_units AS "Defective Units",
       downtime_min AS "Downtime (minutes)"
FROM production WHERE production_date >= {AS_OF} - {ML_DAYS}""", P)
def s11_model_input(fx):
    return ml.model_input(fx.recent(ML_DAYS), ML_DAYS, fx.as_of)


@query("m7_r2", f"""
WITH {_M1.strip()}
SELECT machine_id,
       1 - SUM((downtime_min - downtime_trend) * (downtime_min - downtime_trend))
           / NULLIF(SUM(downtime_min * downtime_min)
                    - SUM(downtime_min) * SUM(downtime_min) / COUNT(downtime_min), 0) AS r2
FROM m1 GROUP BY machine_id""", P)
def m7_r2(fx):
    f = _features(fx)
    return f.groupBy("machine_id").agg(
        ml.r2(F.col("downtime_min"), F.col("downtime_trend")).alias("r2"))


@query("m8_what_if", f"""
WITH {_M1.strip()},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY
           production_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
           l_suppkey DESC) AS r FROM m1) WHERE r = 1),
s AS (SELECT machine_id, units_produced * 1.1 AS u, defective_units * 1.1 AS d, downtime_min,
             units_ma3, defects_ma3, downtime_trend FROM last)
SELECT machine_id, u AS units_produced, d AS defective_units, d / (u + 1) AS defect_rate,
       1 - d / (u + 1) AS quality_score, u / (downtime_min + 1) AS production_efficiency,
       units_ma3, defects_ma3, downtime_trend
FROM s""", P)
def m8_what_if(fx):
    last = windows.last_n(_features(fx), SERIES, ORDER_COLS, 1)
    return ml.what_if(last).select("machine_id", *FEATS)


@query("m9_m10_ensemble_arith", f"""
WITH {_M1.strip()}
SELECT {KEY_SQL},
       downtime_trend * 0.4 + downtime_min * 0.6 AS ensemble_pred,
       1 - abs(downtime_trend - downtime_min) / (abs(downtime_trend) + abs(downtime_min) + 1) AS agreement,
       downtime_trend * 0.4 + downtime_min * 0.6 - abs(downtime_trend - downtime_min) AS band_lower,
       downtime_trend * 0.4 + downtime_min * 0.6 + abs(downtime_trend - downtime_min) AS band_upper
FROM m1""", P)
def m9_m10_ensemble_arith(fx):
    f = _features(fx)
    return ml.ensemble_columns(f.select(*KEYS, "downtime_trend", "downtime_min"),
                               F.col("downtime_trend"), F.col("downtime_min")).select(
        *KEYS, "ensemble_pred", "agreement", "band_lower", "band_upper")


# ---------------------------------------------------------------- M11, M12
def _anomalies(fx, *keep):
    """Per-tenant forests over the scaled features; returns the columns ``keep``
    beside score and flag. Features and statistics are written once and scaled
    when read."""
    f = write_table(_features(fx).select(*dict.fromkeys([*keep, *KEYS, "tenant_id", *FEATS])), "m11-features")
    stats = write_table(ml.scaling_stats(f, FEATS, ["tenant_id"]), "m11-scales")
    z = ml.standardize(f, FEATS, group=["tenant_id"], stats=stats)
    return anomaly.detect_anomalies(z, [f"{c}_z" for c in FEATS], KEYS, group=["tenant_id"],
                                    keep=list(keep), stored=True)


@query("m11_anomaly_flags")
def m11_anomaly_flags(fx):
    return _anomalies(fx, *KEYS, "tenant_id", "machine_id").select(
        *KEYS, "tenant_id", "machine_id", "iforest_score", "is_anomaly")


@query("m11_flag_counts", """
SELECT tenant_id, COUNT(*) AS n_rows,
       -- without ties at the cut, the ranks above 0.9 (n - 1) are flagged
       CASE WHEN COUNT(*) < 5 THEN 0 ELSE COUNT(*) - 1 - CAST(floor(0.9 * (COUNT(*) - 1)) AS BIGINT) END AS expected,
       TRUE AS separated, TRUE AS within_ties
FROM production GROUP BY tenant_id""", P)
def m11_flag_counts(fx):
    """Per tenant: flagged rows score above all others, and their number is the
    expected rank count less at most the rows that tie with the cut."""
    s = _anomalies(fx, "tenant_id").withColumn("_v", F.when(~F.col("is_anomaly"), F.col("iforest_score")))
    agg = s.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anomaly").alias("flagged"), F.max("_v").alias("below"),
        F.min(F.when(F.col("is_anomaly"), F.col("iforest_score"))).alias("above"))
    agg = write_table(agg, "m11-counts")
    ties = (s.select("tenant_id", "iforest_score").join(agg.select("tenant_id", "below"), "tenant_id")
            .filter(F.col("iforest_score") == F.col("below")).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("c")))
    out = agg.join(ties, "tenant_id", "left")
    expected = F.when(F.col("n_rows") < 5, F.lit(0)).otherwise(
        F.col("n_rows") - 1 - F.floor((F.col("n_rows") - 1) * 0.9)).cast("bigint")
    return out.select("tenant_id", "n_rows", expected.alias("expected"),
                      F.coalesce(F.col("above") > F.col("below"), F.lit(True)).alias("separated"),
                      F.col("flagged").between(expected - F.coalesce("c", F.lit(0)), expected).alias("within_ties"))


@query("m12_anomaly_timeline")
def m12_anomaly_timeline(fx):
    return ml.anomaly_timeline(_anomalies(fx, *SERIES, *ORDER_COLS, "downtime_min"), SERIES, ORDER_COLS)


@query("m12_timeline_rows", f"""
SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY {ORDER_SQL}) - 1 AS row_index, downtime_min
FROM production""", P)
def m12_timeline_rows(fx):
    """The timeline's index and downtime (its flags are covered by m11_flag_counts)."""
    return ml.anomaly_timeline(_anomalies(fx, *SERIES, *ORDER_COLS, "downtime_min"), SERIES, ORDER_COLS).drop("is_anomaly")


# ---------------------------------------------------------------- M4-M6, O5, M13/M14
def _ml_analysis(fx):
    """M14 the single-plant ML route over the trailing 30 days."""
    from .report import ml_analysis
    win = trailing_window(fx.recent(ML_DAYS), ML_DAYS, fx.as_of)
    rows = win.select(*KEYS, "production_date", "machine_id", "units_produced",
                      "defective_units", "downtime_min")
    return ml_analysis(rows, KEYS, ORDER_COLS)


@query("m14_empty_window", """
SELECT CAST(0 AS DOUBLE) AS prediction, CAST(0 AS DOUBLE) AS confidence, CAST(count(*) AS INTEGER) AS anomalies_detected
FROM production WHERE production_date > (SELECT max(production_date) FROM production)""", P)
def m14_empty_window(fx):
    """M14 below the 5-row gate: the rows after the last day."""
    from .report import ml_analysis
    rows = fx.production.filter(F.col("production_date") > F.lit(fx.as_of))
    return ml_analysis(rows, KEYS, ORDER_COLS).record.select("prediction", "confidence", "anomalies_detected")


@query("m14_ml_analysis")
def m14_ml_analysis(fx):
    return _ml_analysis(fx).record


@query("m6_o5_top_importances")
def m6_o5_top_importances(fx):
    return ml.importances_frame(fx.spark, _ml_analysis(fx).ensemble, top=6)


# ---------------------------------------------------------------- forecasts
_DAILY = """
d AS (SELECT machine_id, production_date, AVG(downtime_min) AS y, CAST(COUNT(*) AS BIGINT) AS n_rows
      FROM production GROUP BY machine_id, production_date)"""


def _daily(fx):
    return forecast.daily_series(fx.production, SERIES)


@query("m15_minmax", f"""
WITH {_DAILY.strip()},
s AS (SELECT *, min(y) OVER (PARTITION BY machine_id) AS y_min,
             max(y) OVER (PARTITION BY machine_id) AS y_max FROM d)
SELECT *, CASE WHEN y_max > y_min THEN (y - y_min) / (y_max - y_min) ELSE 0.0 END AS y_scaled
FROM s""", P)
def m15_minmax(fx):
    return forecast.minmax(_daily(fx), SERIES)


def _ar_sql(lookback: int = forecast.LOOKBACK) -> str:
    """The same normal equations, eliminated row by row in a recursive query."""
    x = ["1.0"] + [f"lag_{j}" for j in range(lookback, 0, -1)] + ["ys"]
    m = ", ".join("[" + ", ".join(f"SUM({x[i]} * {x[j]})" + (" + 1e-6" if i == j and i else "")
                                  for j in range(lookback + 2)) + "]" for i in range(lookback + 1))
    lags = ", ".join(f"lag(ys, {j}) OVER w AS lag_{j}" for j in range(1, lookback + 1))
    return f"""
WITH RECURSIVE {_DAILY.strip()},
s AS (SELECT *, min(y) OVER (PARTITION BY machine_id) AS lo, max(y) OVER (PARTITION BY machine_id) AS hi FROM d),
sc AS (SELECT machine_id, production_date, CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0.0 END AS ys FROM s),
l AS (SELECT *, {lags}, row_number() OVER w AS pos, COUNT(*) OVER (PARTITION BY machine_id) - {lookback} AS n
      FROM sc WINDOW w AS (PARTITION BY machine_id ORDER BY production_date)),
e AS (SELECT machine_id, 1 AS k, CAST(COUNT(*) AS INTEGER) AS n_train, [{m}] AS m FROM l
      WHERE pos > {lookback} AND (pos - {lookback} <= floor(n * 0.8) OR floor(n * 0.8) < 1) GROUP BY machine_id),
g AS (SELECT * FROM e UNION ALL
      SELECT machine_id, k + 1, n_train, list_transform(m, lambda row, i: CASE WHEN i = k THEN row ELSE
        list_transform(row, lambda v, j: v - m[k][j] * (row[k] / m[k][k])) END) FROM g WHERE k <= {lookback + 1}),
b AS (SELECT machine_id, n_train, list_transform(m, lambda row, i: row[{lookback + 2}] / row[i]) AS b
      FROM g WHERE k = {lookback + 2})
SELECT machine_id, b[1] AS intercept, b[2:] AS coef, n_train FROM b"""


@query("m16_ar_coefficients", _ar_sql(), P)
def m16_ar_coefficients(fx):
    return forecast.fit_ar(_daily(fx), SERIES)


@query("m16_normal_equations", f"""
WITH {_DAILY.strip()}
SELECT machine_id, COUNT(*) - 10 AS n_rows, CAST(floor(0.8 * (COUNT(*) - 10)) AS BIGINT) AS n_train, TRUE AS solved
FROM d GROUP BY machine_id HAVING floor(0.8 * (COUNT(*) - 10)) >= 1""", P)
def m16_normal_equations(fx):
    """The fitted residuals of the training rows are orthogonal to the lags, up
    to the ridge's share of the coefficients."""
    rows = write_table(forecast.ar_training_rows(_daily(fx), SERIES), "m16-rows")
    lags = [F.col(f"lag_{j}") for j in range(forecast.LOOKBACK, 0, -1)]
    fit = forecast.fit_ar(_daily(fx), SERIES)
    r = rows.join(fit, "machine_id")
    b = [F.element_at("coef", j + 1) for j in range(forecast.LOOKBACK)]
    resid = F.col("y_scaled") - F.col("intercept") - sum((x * c for x, c in zip(lags, b)), F.lit(0.0))
    sums = [F.abs(F.sum(F.when(F.col("is_train"), x * resid))) for x in [F.lit(1.0), *lags]]
    return (r.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_train").alias("n_train"),
                                        F.greatest(*sums).alias("_g"), F.first("coef").alias("_b"))
            .filter("n_train >= 1")
            .select("machine_id", "n_rows", "n_train", (F.col("_g") <= 1e-6 * (1 + F.aggregate(
                "_b", F.lit(0.0), lambda a, x: a + F.abs(x)))).alias("solved")))


_FIXED_AR = f"""
WITH RECURSIVE {_DAILY.strip()},
s AS (SELECT *, min(y) OVER (PARTITION BY machine_id) AS lo,
             max(y) OVER (PARTITION BY machine_id) AS hi FROM d),
sc AS (SELECT *, CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0.0 END AS ys,
              row_number() OVER (PARTITION BY machine_id ORDER BY production_date DESC) AS r FROM s),
st AS (SELECT machine_id, list(ys ORDER BY production_date) AS hist, max(production_date) AS last_date,
              any_value(lo) AS lo, any_value(hi) AS hi
       FROM sc WHERE r <= 10 GROUP BY machine_id HAVING count(*) = 10),
f AS (
  SELECT machine_id, 0 AS step, hist, CAST(NULL AS DOUBLE) AS yhat_scaled, last_date, lo, hi FROM st
  UNION ALL
  SELECT machine_id, step + 1, list_append(hist[2:], nxt), nxt, last_date, lo, hi
  FROM (SELECT *, list_reduce(list_prepend(0.0, list_transform(hist, lambda x: 0.1 * x)),
                              lambda a, b: a + b) AS nxt FROM f WHERE step < 7)),
sd AS (SELECT machine_id, stddev_samp(y) AS sd FROM d GROUP BY machine_id),
fc AS (SELECT f.machine_id, CAST(step AS INTEGER) AS step, CAST(last_date + step AS DATE) AS ds,
              yhat_scaled * (hi - lo) + lo AS yhat, sd.sd
       FROM f JOIN sd ON f.machine_id = sd.machine_id WHERE step > 0)"""


def _fixed_ar(fx):
    daily = _daily(fx)
    state = forecast.ar_state(daily, SERIES)
    coefs = state.select(*SERIES, F.lit(0.0).alias("intercept"),
                         F.array(*[F.lit(0.1)] * 10).alias("coef"))
    fc = forecast.recursive_forecast(state, coefs, SERIES)
    return forecast.with_history_band(fc, daily, SERIES)


@query("m17_m18_recursive_band", _FIXED_AR + """
SELECT machine_id, step, ds, yhat, yhat - 1.96 * sd AS lower, yhat + 1.96 * sd AS upper FROM fc""", P)
def m17_m18_recursive_band(fx):
    return _fixed_ar(fx)


_TREND = """
dt AS (SELECT *, CAST(production_date - DATE '1970-01-01' AS DOUBLE) AS t FROM d),
lin AS (SELECT machine_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
               COUNT(*) AS n_days, max(production_date) AS last_date, stddev_samp(y) AS y_std
        FROM dt GROUP BY machine_id),
res AS (SELECT dt.machine_id, dayofweek(production_date) AS dow,
               y - (intercept + slope * t) AS resid
        FROM dt JOIN lin ON dt.machine_id = lin.machine_id),
eff AS (SELECT machine_id, dow, AVG(resid) AS effect FROM res GROUP BY machine_id, dow),
spr AS (SELECT machine_id, stddev_samp(resid) AS resid_std FROM res GROUP BY machine_id),
fit AS (SELECT lin.*, spr.resid_std FROM lin JOIN spr ON lin.machine_id = spr.machine_id
        WHERE n_days >= 10),
fut AS (SELECT machine_id, CAST(s AS INTEGER) AS step, CAST(last_date + CAST(s AS INTEGER) AS DATE) AS ds
        FROM fit, range(1, 8) r(s)),
frame AS (SELECT * FROM fut {history}),
tw AS (
  SELECT fr.machine_id, fr.ds, fr.step,
         intercept + slope * CAST(fr.ds - DATE '1970-01-01' AS DOUBLE) + COALESCE(eff.effect, 0.0) AS yhat,
         COALESCE(resid_std, 0.0) * 1.2815515655 AS half
  FROM frame fr JOIN fit ON fr.machine_id = fit.machine_id
  LEFT JOIN eff ON eff.machine_id = fr.machine_id AND eff.dow = dayofweek(fr.ds))"""

_TREND_HIST = ("UNION ALL SELECT machine_id, CAST(0 AS INTEGER), production_date FROM d "
               "WHERE machine_id IN (SELECT machine_id FROM fit)")


@query("m19_trend_weekday_forecast", f"""
WITH {_DAILY.strip()},{_TREND.format(history=_TREND_HIST)}
SELECT machine_id, ds, step, yhat, yhat - half AS lower, yhat + half AS upper FROM tw""", P)
def m19_trend_weekday_forecast(fx):
    return forecast.trend_forecast(_daily(fx), SERIES)


@query("m19b_changepoint_forecast")
def m19b_changepoint_forecast(fx):
    return forecast.changepoint_forecast(_daily(fx), SERIES)


@query("m19b_optimality", f"""
WITH {_DAILY.strip()}
SELECT machine_id, COUNT(*) AS n_days,
       CAST(least(25, greatest(CAST(floor(0.8 * COUNT(*)) AS BIGINT), 1) - 1) AS INTEGER) AS n_changepoints, TRUE AS optimal
FROM d GROUP BY machine_id HAVING COUNT(*) >= 10""", P)
def m19b_optimality(fx):
    """Every fit is a minimum of its penalised objective."""
    daily = _daily(fx)
    fits = write_table(forecast.changepoint_fits(daily, SERIES), "m19b-fits")
    return forecast.changepoint_optimality(daily, fits, SERIES)


@query("m20_future_frame", f"""
WITH {_DAILY.strip()},
lin AS (SELECT machine_id, max(production_date) AS last_date FROM d GROUP BY machine_id)
SELECT machine_id, CAST(s AS INTEGER) AS step, CAST(last_date + CAST(s AS INTEGER) AS DATE) AS ds
FROM lin, range(1, 8) r(s)""", P)
def m20_future_frame(fx):
    fit = _daily(fx).groupBy(*SERIES).agg(F.max("production_date").alias("last_date"))
    return forecast.future_frame(fit, SERIES)


@query("m22_linear_trend", f"""
WITH {_DAILY.strip()},
dt AS (SELECT *, CAST(production_date - DATE '1970-01-01' AS DOUBLE) AS t FROM d),
lin AS (SELECT machine_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
               COUNT(*) AS n_days, max(production_date) AS last_date, stddev_samp(y) AS y_std
        FROM dt GROUP BY machine_id HAVING COUNT(*) >= 10),
fut AS (SELECT machine_id, CAST(s AS INTEGER) AS step, CAST(last_date + CAST(s AS INTEGER) AS DATE) AS ds FROM lin, range(1, 8) r(s))
SELECT fut.machine_id, ds, step,
       intercept + slope * CAST(ds - DATE '1970-01-01' AS DOUBLE) AS yhat,
       intercept + slope * CAST(ds - DATE '1970-01-01' AS DOUBLE) - COALESCE(y_std, 0.0) * 1.2815515655 AS lower,
       intercept + slope * CAST(ds - DATE '1970-01-01' AS DOUBLE) + COALESCE(y_std, 0.0) * 1.2815515655 AS upper
FROM fut JOIN lin ON fut.machine_id = lin.machine_id""", P)
def m22_linear_trend(fx):
    return forecast.trend_forecast(_daily(fx), SERIES, weekly=False, include_history=False)


_ENS = _FIXED_AR + ",\n" + _TREND.format(history="").strip() + """,
ens AS (SELECT fc.machine_id, fc.step, fc.ds, (fc.yhat + tw.yhat) / 2 AS yhat
        FROM fc JOIN tw ON fc.machine_id = tw.machine_id AND fc.step = tw.step)"""


def _ensemble(fx):
    tw = forecast.trend_forecast(_daily(fx), SERIES, include_history=False)
    return forecast.ensemble(_fixed_ar(fx), tw, SERIES)


@query("m21_forecast_ensemble", _ENS + "\nSELECT machine_id, step, ds, yhat FROM ens", P)
def m21_forecast_ensemble(fx):
    return _ensemble(fx)


@query("a13_forecast_rollup", _ENS + """
SELECT machine_id, arg_min(yhat, step) AS next_period, AVG(yhat) AS horizon_avg
FROM ens GROUP BY machine_id""", P)
def a13_forecast_rollup(fx):
    return forecast.rollup(_ensemble(fx), SERIES)


@query("m23_forecast_all")
def m23_forecast_all(fx):
    return forecast.forecast_all(fx.production, SERIES)


@query("m23_trend_rows", f"""
WITH {_DAILY.strip()},{_TREND.format(history="")}
SELECT machine_id, step, ds, yhat, yhat - half AS lower, yhat + half AS upper FROM tw""", P)
def m23_trend_rows(fx):
    """The trend rows of the combined forecast."""
    return forecast.forecast_all(fx.production, SERIES).filter("model = 'trend_weekday'").drop("model")


# ---------------------------------------------------------------- M5, M13/M14 per tenant
GAIN_BINS = 16

_M5 = f"""
WITH {_M1.strip()},
t AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, (CAST('0x' || substr(md5(concat_ws('|', '42', {KEY_SQL})), 1, 8) AS BIGINT) % 100) < 80 AS is_train FROM m1),
x AS (SELECT * FROM (UNPIVOT (SELECT rid, tenant_id, downtime_min, {", ".join(FEATS)} FROM t WHERE is_train)
      ON {", ".join(FEATS)} INTO NAME name VALUE v)),
y AS (SELECT *, list_position([{", ".join(f"'{c}'" for c in FEATS)}], name) - 1 AS feature,
             min(v) OVER (PARTITION BY tenant_id, name) AS lo, max(v) OVER (PARTITION BY tenant_id, name) AS hi FROM x),
b AS (SELECT *, len(list_filter(list_transform(range(1, {GAIN_BINS}), lambda i: lo + i * (hi - lo) / {GAIN_BINS}), lambda e: e < v)) AS bin FROM y),
base AS (SELECT tenant_id, AVG(downtime_min) AS m FROM t WHERE is_train GROUP BY tenant_id),
g0 AS (SELECT b.*, m - downtime_min AS g FROM b JOIN base ON b.tenant_id = base.tenant_id),
h1 AS (SELECT tenant_id, 1 AS node, feature, bin, SUM(g) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM g0 GROUP BY ALL),
c1 AS (SELECT *, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER p AS gt, SUM(h) OVER p AS ht FROM h1
       WINDOW p AS (PARTITION BY tenant_id, node, feature), w AS (PARTITION BY tenant_id, node, feature ORDER BY bin)),
s1 AS (SELECT *, round((gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2, 6) AS gain
       FROM c1 WHERE hl >= 1 AND ht - hl >= 1),
k1 AS (SELECT * FROM s1 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, node ORDER BY gain DESC, feature, bin) = 1),
n2 AS (SELECT g0.*, 2 + CAST(o.bin > k1.bin AS INTEGER) AS node FROM g0 JOIN k1 ON g0.tenant_id = k1.tenant_id
       JOIN g0 o ON o.tenant_id = g0.tenant_id AND o.feature = k1.feature AND o.rid = g0.rid),
h2 AS (SELECT tenant_id, node, feature, bin, SUM(g) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM n2 GROUP BY ALL),
c2 AS (SELECT *, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER p AS gt, SUM(h) OVER p AS ht FROM h2
       WINDOW p AS (PARTITION BY tenant_id, node, feature), w AS (PARTITION BY tenant_id, node, feature ORDER BY bin)),
s2 AS (SELECT *, round((gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2, 6) AS gain
       FROM c2 WHERE hl >= 1 AND ht - hl >= 1),
k2 AS (SELECT * FROM s2 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, node ORDER BY gain DESC, feature, bin) = 1),
a AS (SELECT tenant_id, node, feature, bin, gain, ht FROM k1 UNION ALL SELECT tenant_id, node, feature, bin, gain, ht FROM k2)
SELECT tenant_id, node, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(gain, 4) AS gain, CAST(ht AS BIGINT) AS n_rows FROM a"""


@query("m5_split_gains", _M5, P)
def m5_split_gains(fx):
    """The first two levels of the first boosted tree of every tenant."""
    f = write_table(ml.hash_split(_features(fx), KEYS).filter("is_train").select(
        "tenant_id", *dict.fromkeys([*FEATS, "downtime_min"])), "m5-rows")
    edges = trees.bin_edges(f, FEATS, "tenant_id", GAIN_BINS, "width")
    mean = f.groupBy("tenant_id").agg(F.avg("downtime_min").alias("m"))
    tenants = write_table(edges.join(mean, "tenant_id"), "m5-edges")
    rows = write_table(f.join(tenants, "tenant_id").select(  # every level reads the bins
        "tenant_id", trees.binned(f, FEATS).alias("bins"),
        (F.col("m") - F.col("downtime_min")).alias("g"), F.lit(1.0).alias("h")), "m5-bins")
    _, splits = trees.grow(rows, ["tenant_id"], 2, trees.REGULARISATION, "m5-splits")
    return splits.select("tenant_id", "node", "feature", "bin", F.round("gain", 4).alias("gain"),
                         F.col("ht").cast("bigint").alias("n_rows"))


def _tenant_rows(fx):
    return trailing_window(fx.recent(ML_DAYS), ML_DAYS, fx.as_of).select(
        *KEYS, "tenant_id", "production_date", "machine_id", "units_produced", "defective_units", "downtime_min")


def _tenant_models(fx):
    from .report import tenant_models
    rows = write_table(_tenant_rows(fx), "tenant-rows")
    return rows, *tenant_models(rows, KEYS, ORDER_COLS)


@query("m14_tenant_records")
def m14_tenant_records(fx):
    """An insight record per tenant from its own forest and boosted trees."""
    from .report import tenant_records
    return tenant_records(fx.tenants, *_tenant_models(fx))


@query("m14_tenant_gate", f"""
SELECT t.tenant_id, COUNT(p.tenant_id) AS n_rows, COUNT(p.tenant_id) >= 5 AS modelled,
       CASE WHEN COUNT(p.tenant_id) >= 5 THEN {len(FEATS)} ELSE 0 END AS n_features, TRUE AS shares_sum
FROM tenants t LEFT JOIN production p ON p.tenant_id = t.tenant_id AND p.production_date >= {AS_OF} - {ML_DAYS}
GROUP BY t.tenant_id""", ("tenants", "production"))
def m14_tenant_gate(fx):
    """Which tenants have models; their importances are shares of one."""
    from .report import tenant_records
    rows, *models = _tenant_models(fx)
    r = tenant_records(fx.tenants, rows, *models)
    total = F.aggregate(F.map_values("feature_importance"), F.lit(0.0), lambda a, x: a + x)
    n = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return r.join(n, "tenant_id", "left").select(
        "tenant_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("forest_pred").isNotNull().alias("modelled"),
        F.size("feature_importance").alias("n_features"),
        ((F.abs(total - 1) < 1e-9) | (total == 0)).alias("shares_sum"))


@query("m13_tenant_record_fields", f"""
WITH r AS (SELECT * FROM production WHERE production_date >= {AS_OF} - {ML_DAYS}),
k AS (SELECT tenant_id, AVG(downtime_min) AS a, MAX(downtime_min) AS b, COUNT(*) FILTER (downtime_min > 60) AS n,
             SUM(defective_units) / NULLIF(SUM(units_produced), 0) AS rate, COUNT(*) AS c FROM r GROUP BY tenant_id),
j AS (SELECT t.tenant_id, c >= 5 AS m, a, b, n, rate, a * 0.4 + b * 0.6 AS p, 1 - abs(a - b) / (abs(a) + abs(b) + 1) AS s
      FROM tenants t LEFT JOIN k ON k.tenant_id = t.tenant_id),
o AS (SELECT tenant_id, COALESCE(m, FALSE) AS m, CASE WHEN m THEN p ELSE 0.0 END AS prediction, CASE WHEN m THEN s ELSE 0.0 END AS confidence,
        CAST(CASE WHEN m THEN n ELSE 0 END AS INTEGER) AS anomalies_detected, CASE WHEN m THEN p - abs(a - b) END AS band_lower,
        CASE WHEN m THEN p + abs(a - b) END AS band_upper, CASE WHEN m THEN rate ELSE 0.0 END AS rate FROM j)
SELECT tenant_id, prediction, confidence, anomalies_detected, band_lower, band_upper,
  CASE WHEN prediction <= 15 THEN 'Low' WHEN prediction <= 30 THEN 'Medium' WHEN prediction <= 45 THEN 'High' ELSE 'Critical' END AS risk_level,
  concat_ws(',', CASE WHEN prediction > 30 THEN 'maintenance/High' END, CASE WHEN anomalies_detected > 0 THEN 'quality/Medium' END,
    CASE WHEN rate > 0.05 THEN 'quality/High' END) AS fired,
  CASE WHEN m THEN 'Defect_Rate=0.25,Units Produced=0.75' ELSE '' END AS shares
FROM o""", ("tenants", "production"))
def m13_tenant_record_fields(fx):
    """Every arithmetic field of the records, from simple stand-ins for the models."""
    from .report import tenant_records
    rows = _tenant_rows(fx)
    k = rows.groupBy("tenant_id").agg(
        F.avg("downtime_min").alias("forest_pred"), F.max("downtime_min").alias("boost_pred"),
        F.count_if(F.col("downtime_min") > 60).alias("anomalies_detected"), F.count(F.lit(1)).alias("c")).filter("c >= 5")
    none = F.lit(None).cast("double")
    shares = k.select("tenant_id", F.explode(F.array(
        F.struct(F.lit("units_produced").alias("feature"), F.lit(0.75).alias("importance")),
        F.struct(F.lit("defect_rate").alias("feature"), F.lit(0.25).alias("importance")))).alias("s")).select("tenant_id", "s.*")
    r = tenant_records(fx.tenants, rows, k.select("tenant_id", "forest_pred", "boost_pred", none.alias("forest_r2"), none.alias("boost_r2")),
                       shares, k.select("tenant_id", "anomalies_detected"))
    return r.select(
        "tenant_id", "prediction", "confidence", "anomalies_detected", "band_lower", "band_upper", "risk_level",
        F.array_join(F.transform("recommendations", lambda x: F.concat_ws("/", x["type"], x["priority"])), ",").alias("fired"),
        F.array_join(F.transform(F.map_entries("feature_importance"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
                     ",").alias("shares"))


# ---------------------------------------------------------------- C3
@query("c3_insight_bundle")
def c3_insight_bundle(fx):
    """KPIs of all days; predictions, importances and anomalies of each tenant's
    own models over the ML window."""
    from .report import insight_bundle, tenant_models
    predictions, importances, anomalies = tenant_models(write_table(_tenant_rows(fx), "tenant-rows"), KEYS, ORDER_COLS)
    return insight_bundle(fx.production, predictions, importances, anomalies, generated_at=F.lit(NOW).cast("timestamp"))
