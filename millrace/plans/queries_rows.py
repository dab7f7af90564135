"""Cleaning, union, constraints and row-order operators: registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, windows
from ..operators.common import trailing_window
from ..sources.fixtures import ORDER_COLS
from .catalog import query
from .oracle_views import AS_OF

P = ("production",)
PD = ("production_dirty",)
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER_SQL = "production_date, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SERIES = ["machine_id"]


# ---------------------------------------------------------------- P1, P2
@query("p1_display_names", f"""
SELECT {KEY_SQL}, production_date AS "Date", machine_id AS "Machine ID",
       units_produced AS "Units Produced", defective_units AS "Defective Units",
       downtime_min AS "Downtime (minutes)", shift AS "Shift"
FROM production""", P)
def p1_display_names(fx):
    return clean.to_display(fx.production.drop("tenant_id"))


_P2_SRC = """
SELECT {keys},
       CASE WHEN l_linenumber = 6 THEN 'n/a' ELSE CAST(units_produced AS VARCHAR) END AS units_produced,
       CAST(defective_units AS VARCHAR) AS defective_units,
       CASE WHEN l_linenumber = 5 THEN '' ELSE CAST(downtime_min AS VARCHAR) END AS downtime_min
FROM production_dirty"""


@query("p2_coerce_numeric", f"""
WITH src AS ({_P2_SRC.format(keys=KEY_SQL).strip()})
SELECT {KEY_SQL},
       COALESCE(TRY_CAST(units_produced AS DOUBLE), 0.0) AS units_produced,
       COALESCE(TRY_CAST(defective_units AS DOUBLE), 0.0) AS defective_units,
       COALESCE(TRY_CAST(downtime_min AS DOUBLE), 0.0) AS downtime_min
FROM src""", PD)
def p2_coerce_numeric(fx):
    d = fx.production_dirty
    src = d.select(
        *KEYS,
        F.when(F.col("l_linenumber") == 6, F.lit("n/a"))
         .otherwise(F.col("units_produced").cast("string")).alias("units_produced"),
        F.col("defective_units").cast("string").alias("defective_units"),
        F.when(F.col("l_linenumber") == 5, F.lit(""))
         .otherwise(F.col("downtime_min").cast("string")).alias("downtime_min"))
    return clean.coerce_numeric(src)


# ---------------------------------------------------------------- P10-P12, C2
_DIRTY_COLS = f"{KEY_SQL}, tenant_id, production_date, machine_id"


@query("p10_fill_nulls", f"""
SELECT {_DIRTY_COLS}, COALESCE(units_produced, 0.0) AS units_produced,
       COALESCE(defective_units, 0.0) AS defective_units,
       COALESCE(downtime_min, 0.0) AS downtime_min, COALESCE(shift, '0') AS shift
FROM production_dirty""", PD)
def p10_fill_nulls(fx):
    return clean.fill_nulls(fx.production_dirty)


@query("p11_clip_negative", f"""
SELECT {_DIRTY_COLS}, CASE WHEN units_produced < 0 THEN 0.0 ELSE units_produced END AS units_produced,
       CASE WHEN defective_units < 0 THEN 0.0 ELSE defective_units END AS defective_units,
       CASE WHEN downtime_min < 0 THEN 0.0 ELSE downtime_min END AS downtime_min, shift
FROM production_dirty""", PD)
def p11_clip_negative(fx):
    return clean.clip_negative(fx.production_dirty)


@query("p12_cap_defects", f"""
SELECT {_DIRTY_COLS}, units_produced,
       CASE WHEN defective_units > units_produced THEN units_produced ELSE defective_units END AS defective_units,
       downtime_min, shift
FROM production_dirty""", PD)
def p12_cap_defects(fx):
    return clean.cap_defects(fx.production_dirty)


_C2 = f"""
WITH f AS (
  SELECT {_DIRTY_COLS},
         greatest(COALESCE(units_produced, 0.0), 0.0) AS u,
         greatest(COALESCE(defective_units, 0.0), 0.0) AS d,
         greatest(COALESCE(downtime_min, 0.0), 0.0) AS t, COALESCE(shift, '0') AS shift
  FROM production_dirty)
SELECT {_DIRTY_COLS}, u AS units_produced, least(d, u) AS defective_units,
       t AS downtime_min, shift FROM f"""


@query("c2_validate", _C2, PD)
def c2_validate(fx):
    return clean.validate(fx.production_dirty)


# ---------------------------------------------------------------- P13, K3
_P13 = """
WITH a AS (
  SELECT
    COUNT(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL OR l_partkey IS NULL
      OR l_suppkey IS NULL OR tenant_id IS NULL OR production_date IS NULL OR machine_id IS NULL
      OR units_produced IS NULL OR isnan(units_produced) OR defective_units IS NULL
      OR isnan(defective_units) OR downtime_min IS NULL OR isnan(downtime_min) OR shift IS NULL)
      AS missing,
    COUNT(*) FILTER (WHERE COALESCE(units_produced, 0) < 0) AS neg_u,
    COUNT(*) FILTER (WHERE COALESCE(defective_units, 0) < 0) AS neg_d,
    COUNT(*) FILTER (WHERE COALESCE(downtime_min, 0) < 0) AS neg_t,
    COUNT(*) FILTER (WHERE greatest(COALESCE(defective_units, 0), 0)
                           > greatest(COALESCE(units_produced, 0), 0)) AS capped
  FROM {src}),
r AS (
  SELECT 1 AS step, 'missing' AS rule, 'Missing values detected and zeroed.' AS message, missing AS n_rows FROM a
  UNION ALL SELECT 2, 'negative:units_produced', 'Negative values in Units Produced corrected.', neg_u FROM a
  UNION ALL SELECT 3, 'negative:defective_units', 'Negative values in Defective Units corrected.', neg_d FROM a
  UNION ALL SELECT 4, 'negative:downtime_min', 'Negative values in Downtime (minutes) corrected.', neg_t FROM a
  UNION ALL SELECT 5, 'capped', 'Defects exceeded production; capped at production value.', capped FROM a),
f AS (SELECT * FROM r WHERE n_rows > 0)
SELECT step, rule, message, CAST(n_rows AS BIGINT) AS n_rows FROM f
UNION ALL
SELECT 0, 'ok', 'Validation successful: No errors found in the dataset.', CAST(0 AS BIGINT)
WHERE NOT EXISTS (SELECT 1 FROM f)"""


@query("p13_validation_report", _P13.format(src="production_dirty"), PD)
def p13_validation_report(fx):
    return clean.validation_report(fx.production_dirty)


@query("p13_validation_report_clean", _P13.format(src="production"), P)
def p13_validation_report_clean(fx):
    return clean.validation_report(fx.production)


@query("k3_validation_log", f"""
WITH rep AS ({_P13.format(src="production_dirty").strip()})
SELECT CASE WHEN bool_or(rule = 'ok') THEN 'Validation successful: No errors found in the dataset.'
            ELSE 'VALIDATION ERRORS FOUND AND FIXED:' || chr(10) || string_agg(message, chr(10) ORDER BY step)
       END AS text
FROM rep""", PD)
def k3_validation_log(fx):
    return clean.validation_log_text(clean.validation_report(fx.production_dirty))


# ---------------------------------------------------------------- U1, C1
@query("u1_union_history_live", f"""
SELECT * FROM (SELECT * FROM production WHERE production_date >= {AS_OF} - 7)
UNION ALL BY NAME
SELECT * FROM live_records""", ("production", "live_records"))
def u1_union_history_live(fx):
    return clean.union_sources(trailing_window(fx.recent(7), 7, fx.as_of), fx.live_records)


@query("c1_load_for_report", f"""
WITH u AS (
  SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift
  FROM production WHERE production_date >= {AS_OF} - 7
  UNION ALL
  SELECT production_date, machine_id, units_produced, defective_units, downtime_min, shift
  FROM live_records)
SELECT production_date AS "Date", machine_id AS "Machine ID",
       COALESCE(units_produced, 0.0) AS "Units Produced",
       COALESCE(defective_units, 0.0) AS "Defective Units",
       COALESCE(downtime_min, 0.0) AS "Downtime (minutes)", shift AS "Shift"
FROM u""", ("production", "live_records"))
def c1_load_for_report(fx):
    from ..plans.report import load_for_report
    return load_for_report(fx.recent(7), fx.live_records, 7, fx.as_of)


# ---------------------------------------------------------------- D2
@query("d2_constraint_check", """
WITH v AS (
  SELECT CASE
    WHEN production_date IS NULL THEN 'not_null:production_date'
    WHEN machine_id IS NULL THEN 'not_null:machine_id'
    WHEN units_produced IS NULL THEN 'not_null:units_produced'
    WHEN defective_units IS NULL THEN 'not_null:defective_units'
    WHEN downtime_min IS NULL THEN 'not_null:downtime_min'
    WHEN shift IS NULL THEN 'not_null:shift'
    WHEN length(tenant_id) > 50 THEN 'varchar50:tenant_id'
    WHEN length(machine_id) > 50 THEN 'varchar50:machine_id'
    WHEN length(shift) > 20 THEN 'varchar20:shift'
    END AS violation
  FROM production_dirty)
SELECT COALESCE(violation, 'accepted') AS outcome, CAST(COUNT(*) AS BIGINT) AS n_rows
FROM v GROUP BY 1""", PD)
def d2_constraint_check(fx):
    v = clean.constraint_violation(fx.production_dirty, "production")
    return (fx.production_dirty.select(F.coalesce(v, F.lit("accepted")).alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- W1, W2
_W1 = f"""
WITH s AS (SELECT *, COUNT(*) OVER (PARTITION BY machine_id) AS n FROM production)
SELECT {KEY_SQL}, production_date, machine_id, units_produced, defective_units, downtime_min,
       CASE WHEN n < 5 THEN units_produced ELSE AVG(units_produced) OVER w END AS units_ma3,
       CASE WHEN n < 5 THEN defective_units ELSE AVG(defective_units) OVER w END AS defects_ma3,
       CASE WHEN n < 5 THEN downtime_min ELSE AVG(downtime_min) OVER w END AS downtime_trend
FROM s
WINDOW w AS (PARTITION BY machine_id ORDER BY {ORDER_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""

_PROD_SEL = KEYS + ["production_date", "machine_id", "units_produced", "defective_units",
                    "downtime_min"]


@query("w1_rolling_means", _W1, P)
def w1_rolling_means(fx):
    p = fx.production.select(*_PROD_SEL)
    return windows.trailing_means(
        p, SERIES, ORDER_COLS,
        {"units_ma3": "units_produced", "defects_ma3": "defective_units",
         "downtime_trend": "downtime_min"}, window=3, min_rows=5)


@query("w2_downtime_ma5", f"""
SELECT {KEY_SQL}, machine_id, downtime_min,
       AVG(downtime_min) OVER (PARTITION BY machine_id ORDER BY {ORDER_SQL}
                               ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS downtime_ma5
FROM production""", P)
def w2_downtime_ma5(fx):
    p = fx.production.select(*KEYS, "production_date", "machine_id", "downtime_min")
    return windows.trailing_means(p, SERIES, ORDER_COLS, {"downtime_ma5": "downtime_min"},
                                  window=5).drop("production_date")


# ---------------------------------------------------------------- W3
_LAGS = ",\n       ".join(f"lag(downtime_min, {j}) OVER w AS lag_{j}" for j in range(1, 11))


@query("w3_lag_sequences", f"""
WITH s AS (
  SELECT {KEY_SQL}, machine_id, downtime_min,
         row_number() OVER w AS seq_pos,
         {_LAGS}
  FROM production
  WINDOW w AS (PARTITION BY machine_id ORDER BY {ORDER_SQL}))
SELECT * FROM s WHERE seq_pos > 10""", P)
def w3_lag_sequences(fx):
    p = fx.production.select(*KEYS, "production_date", "machine_id", "downtime_min")
    return windows.lag_features(p, SERIES, ORDER_COLS, "downtime_min", 10).drop(
        "production_date")


# ---------------------------------------------------------------- W4
@query("w4_last_rows", f"""
SELECT * FROM (
  SELECT {KEY_SQL}, machine_id, production_date, downtime_min,
         row_number() OVER (PARTITION BY machine_id ORDER BY production_date DESC,
           l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS tail_rank
  FROM production) WHERE tail_rank <= 12""", P)
def w4_last_rows(fx):
    p = fx.production.select(*KEYS, "machine_id", "production_date", "downtime_min")
    return windows.last_n(p, SERIES, ORDER_COLS, 12)


# ---------------------------------------------------------------- W5, W6, W7
_POS = f"""
WITH s AS (
  SELECT {KEY_SQL}, machine_id, production_date, downtime_min,
         row_number() OVER (PARTITION BY machine_id ORDER BY {ORDER_SQL}) AS pos,
         COUNT(*) OVER (PARTITION BY machine_id) AS n
  FROM production)"""


@query("w5_chrono_split", _POS + """
SELECT *, pos <= floor(CAST(n AS DOUBLE) * 0.8) AS is_train FROM s""", P)
def w5_chrono_split(fx):
    p = fx.production.select(*KEYS, "machine_id", "production_date", "downtime_min")
    return windows.chrono_split(p, SERIES, ORDER_COLS, 0.8)


@query("w6_row_index", _POS + f"""
SELECT {KEY_SQL}, machine_id, production_date, downtime_min, pos - 1 AS row_index FROM s""", P)
def w6_row_index(fx):
    p = fx.production.select(*KEYS, "machine_id", "production_date", "downtime_min")
    return windows.row_index(p, SERIES, ORDER_COLS)


@query("w7_synthesized_dates", _POS + f"""
SELECT *, CAST({AS_OF} + CAST(pos - n AS INTEGER) AS DATE) AS ds FROM s""", P)
def w7_synthesized_dates(fx):
    p = fx.production.select(*KEYS, "machine_id", "production_date", "downtime_min")
    return windows.synthesized_dates(p, SERIES, ORDER_COLS, fx.as_of)


# ---------------------------------------------- W1, W5 on null dates and machines
_GAPS = f"""
WITH g AS (
  SELECT {KEY_SQL}, CASE WHEN l_linenumber = 3 THEN NULL ELSE production_date END AS production_date,
         CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN NULL ELSE machine_id END AS machine_id, downtime_min
  FROM production)
SELECT *, AVG(downtime_min) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS downtime_ma3,
       row_number() OVER w AS pos, COUNT(*) OVER (PARTITION BY machine_id) AS n,
       row_number() OVER w <= floor(CAST(COUNT(*) OVER (PARTITION BY machine_id) AS DOUBLE) * 0.8) AS is_train
FROM g WINDOW w AS (PARTITION BY machine_id ORDER BY production_date NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


@query("w1_w5_null_keys", _GAPS, P)
def w1_w5_null_keys(fx):
    p = fx.production.select(
        *KEYS, F.when(F.col("l_linenumber") != 3, F.col("production_date")).alias("production_date"),
        F.when((F.col("l_orderkey") % 7 != 0) | (F.col("l_linenumber") != 2), F.col("machine_id")).alias("machine_id"),
        "downtime_min")
    means = windows.trailing_means(p, SERIES, ORDER_COLS, {"downtime_ma3": "downtime_min"}, window=3)
    return windows.chrono_split(means, SERIES, ORDER_COLS, 0.8)


# ---------------------------------------------------------------- W8
@query("w8_latest_reading", """
SELECT machine_id, ts, event_id, production_date, units_produced, defective_units, downtime_min
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS r
      FROM live_records) WHERE r = 1""", ("live_records",))
def w8_latest_reading(fx):
    return windows.latest_reading(
        fx.live_records, ["machine_id"], ["ts", "event_id"],
        ["production_date", "units_produced", "defective_units", "downtime_min"])


# ---------------------------------------------------------------- P14
@query("p14_sample_gates", """
SELECT machine_id, CAST(COUNT(*) AS BIGINT) AS n_rows, COUNT(*) >= 20 AS enough
FROM production GROUP BY machine_id""", P)
def p14_sample_gates(fx):
    return windows.sample_gate(fx.production, SERIES, 20)
