"""Bands, narratives, formats, JSON, text sanitising and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import narrative as N
from ..functions import text as X
from ..operators import kpi
from .catalog import query

P = ("production",)

# Per-machine inputs for the prediction-driven rules: the mean downtime
# stands in for a model prediction; readings of 78+ minutes count as
# anomalies. (Fixture parameters, the same on both sides.)
_MACHINE_IN = """
m AS (SELECT machine_id, AVG(downtime_min) AS pred,
             CAST(COUNT(*) FILTER (WHERE downtime_min >= 78) AS BIGINT) AS anomalies,
             SUM(defective_units) / NULLIF(SUM(units_produced), 0) AS defect_rate
      FROM production GROUP BY machine_id)"""


def _machine_in(fx):
    return fx.production.groupBy("machine_id").agg(
        F.avg("downtime_min").alias("pred"),
        F.count_if(F.col("downtime_min") >= 78).alias("anomalies"),
        F.try_divide(F.sum("defective_units"), F.sum("units_produced")).alias("defect_rate"))


_TENANT_KPI = """
k AS (SELECT tenant_id, CAST(trunc(SUM(units_produced)) AS BIGINT) AS total_units,
             CAST(trunc(SUM(defective_units)) AS BIGINT) AS total_defects,
             ROUND(CASE WHEN SUM(units_produced) > 0
                   THEN (SUM(units_produced) - SUM(defective_units)) / SUM(units_produced) * 100
                   ELSE 0.0 END, 2) AS yield_pct,
             ROUND(AVG(downtime_min), 2) AS avg_downtime_min,
             CAST(COUNT(*) FILTER (WHERE downtime_min >= 78) AS BIGINT) AS anomalies
      FROM production GROUP BY tenant_id)"""


def _tenant_kpi(fx):
    k = kpi.report_kpis(fx.production, ["tenant_id"], fx.as_of)
    a = fx.production.groupBy("tenant_id").agg(
        F.count_if(F.col("downtime_min") >= 78).alias("anomalies"))
    return k.drop("report_date").join(a, "tenant_id")


# ---------------------------------------------------------------- F4, F5
@query("f4_f5_risk_bands", f"""
WITH {_MACHINE_IN.strip()}
SELECT machine_id, pred,
       CASE WHEN pred <= 15 THEN 'Low' WHEN pred <= 30 THEN 'Medium'
            WHEN pred <= 45 THEN 'High' ELSE 'Critical' END AS risk_level,
       CASE WHEN pred > 40 THEN 'High' WHEN pred > 20 THEN 'Medium' ELSE 'Low' END AS basic_risk
FROM m""", P)
def f4_f5_risk_bands(fx):
    m = _machine_in(fx)
    return m.select("machine_id", "pred", N.risk_level(F.col("pred")).alias("risk_level"),
                    N.basic_risk(F.col("pred")).alias("basic_risk"))


# ---------------------------------------------------------------- F6, F7
_QB = """CASE WHEN yield_pct >= 99 THEN 'Excellent - exceeding industry standards'
            WHEN yield_pct >= 97 THEN 'Good - meeting quality targets'
            WHEN yield_pct >= 95 THEN 'Acceptable - some improvement needed'
            ELSE 'Below target - immediate action required' END"""
_DB = """CASE WHEN avg_downtime_min < 10 THEN 'Optimal - minimal disruption'
            WHEN avg_downtime_min < 20 THEN 'Moderate - within acceptable range'
            WHEN avg_downtime_min < 30 THEN 'Elevated - review maintenance schedule'
            ELSE 'Critical - requires immediate attention' END"""


@query("f6_f7_performance_text", f"""
WITH {_TENANT_KPI.strip()}
SELECT tenant_id, {_QB} AS quality_assessment, {_DB} AS downtime_assessment,
       'Quality Performance: ' || {_QB} || '. With ' || CAST(total_defects AS VARCHAR)
       || ' defective units out of ' || CAST(total_units AS VARCHAR)
       || ' produced, the manufacturing process demonstrates '
       || CASE WHEN yield_pct >= 97 THEN 'strong' ELSE 'adequate' END
       || ' quality control.' || chr(10) || chr(10) || 'Operational Efficiency: ' || {_DB}
       || '. Current downtime levels '
       || CASE WHEN avg_downtime_min < 20 THEN 'support' ELSE 'impact' END
       || ' overall equipment effectiveness (OEE).' || chr(10) || chr(10) || 'Key Focus Areas: '
       || CASE WHEN yield_pct >= 97 AND avg_downtime_min < 20 THEN 'Continue current practices'
               ELSE 'Prioritize quality improvements and downtime reduction' END
       || ' to maintain competitive advantage.' AS performance_text
FROM k""", P)
def f6_f7_performance_text(fx):
    k = _tenant_kpi(fx)
    y, d = F.col("yield_pct"), F.col("avg_downtime_min")
    return k.select("tenant_id", N.quality_band(y).alias("quality_assessment"),
                    N.downtime_band(d).alias("downtime_assessment"),
                    N.performance_text(F.col("total_units"), F.col("total_defects"), y, d)
                    .alias("performance_text"))


# ---------------------------------------------------------------- F8
@query("f8_report_recommendations", f"""
WITH {_TENANT_KPI.strip()},
r AS (
  SELECT tenant_id, 1 AS o, '- Investigate root causes of defects to improve yield above 98%' AS line
    FROM k WHERE yield_pct < 98
  UNION ALL SELECT tenant_id, 2, '- Implement predictive maintenance to reduce downtime below 15 minutes'
    FROM k WHERE avg_downtime_min > 15
  UNION ALL SELECT tenant_id, 3, '- Review detected anomalies for potential process improvements'
    FROM k WHERE anomalies > 5),
d AS (
  SELECT tenant_id, 4 AS o, '- Maintain current operational excellence' AS line FROM k
    WHERE tenant_id NOT IN (SELECT tenant_id FROM r)
  UNION ALL SELECT tenant_id, 5, '- Continue monitoring for early detection of issues' FROM k
    WHERE tenant_id NOT IN (SELECT tenant_id FROM r)),
c AS (
  SELECT tenant_id, 6 AS o, '- Utilize ML forecasts for proactive resource planning' AS line FROM k
  UNION ALL SELECT tenant_id, 7, '- Review detailed analytics in following sections for deeper insights' FROM k),
a AS (SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM c)
SELECT tenant_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY o) - 1 AS INTEGER) AS pos, line
FROM a""", P)
def f8_report_recommendations(fx):
    k = _tenant_kpi(fx)
    recs = N.report_recommendations(F.col("yield_pct"), F.col("avg_downtime_min"),
                                    F.col("anomalies"))
    return k.select("tenant_id", F.posexplode(recs).alias("pos", "line"))


# ---------------------------------------------------------------- F9
@query("f9_ml_recommendations", f"""
WITH {_MACHINE_IN.strip()},
r AS (
  SELECT machine_id, 1 AS o, 'maintenance' AS type, 'High' AS priority,
         'Schedule preventive maintenance to reduce predicted downtime' AS message,
         'Predicted downtime is ' || printf('%.1f', pred) || ' min - schedule maintenance within 24 hours' AS action
  FROM m WHERE pred > 30
  UNION ALL
  SELECT machine_id, 2, 'quality', 'Medium', CAST(anomalies AS VARCHAR) || ' production anomalies detected',
         'Investigate unusual patterns in recent production data' FROM m WHERE anomalies > 0
  UNION ALL
  SELECT machine_id, 3, 'quality', 'High', 'Defect rate exceeds acceptable threshold',
         'Review quality control procedures and inspect machinery' FROM m WHERE defect_rate > 0.05)
SELECT machine_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY o) - 1 AS INTEGER) AS pos,
       type, priority, message, action
FROM r""", P)
def f9_ml_recommendations(fx):
    m = _machine_in(fx)
    recs = N.ml_recommendations(F.col("pred"), F.col("anomalies"), F.col("defect_rate"))
    return (m.select("machine_id", F.posexplode(recs).alias("pos", "r"))
            .select("machine_id", "pos", "r.type", "r.priority", "r.message", "r.action"))


# ---------------------------------------------------------------- F10, F11, K4
@query("f10_metric_strings", """
WITH t AS (SELECT tenant_id, AVG(downtime_min) AS ad,
                  SUM(defective_units) / SUM(units_produced) AS dr,
                  CAST(trunc(SUM(units_produced)) AS BIGINT) AS tu
           FROM production GROUP BY tenant_id)
SELECT tenant_id, printf('%.1f', ad) || ' min' AS downtime_text,
       printf('%.1f', dr * 100) || '%' AS defect_text,
       printf('%,d', tu) AS units_text
FROM t""", P)
def f10_metric_strings(fx):
    t = fx.production.groupBy("tenant_id").agg(
        F.avg("downtime_min").alias("ad"),
        (F.sum("defective_units") / F.sum("units_produced")).alias("dr"),
        F.sum("units_produced").cast("bigint").alias("tu"))
    return t.select("tenant_id", X.minutes_text(F.col("ad")).alias("downtime_text"),
                    X.percent_text(F.col("dr")).alias("defect_text"),
                    X.thousands(F.col("tu")).alias("units_text"))


@query("k4_records_json", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       to_json({'production_date': strftime(production_date, '%Y-%m-%d'), 'machine_id': machine_id,
                'units_produced': units_produced, 'defective_units': defective_units,
                'downtime_min': downtime_min, 'shift': shift})::VARCHAR AS record
FROM production""", P)
def k4_records_json(fx):
    from ..sources.sinks import records_json
    return records_json(fx.production, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("k4_records_json_dirty", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       to_json({'production_date': strftime(production_date, '%Y-%m-%d'), 'machine_id': machine_id,
                'units_produced': units_produced, 'defective_units': defective_units,
                'downtime_min': downtime_min, 'shift': shift})::VARCHAR AS record
FROM production_dirty""", ("production_dirty",))
def k4_records_json_dirty(fx):
    from ..sources.sinks import records_json
    return records_json(fx.production_dirty, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# ---------------------------------------------------------------- F12
@query("f12_config_json", """
WITH c AS (
  SELECT tenant_id, '{"line":' || CAST(n_nationkey AS VARCHAR) || '}' AS config
  FROM (SELECT concat('PLANT_', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS tenant_id, n_nationkey
        FROM nation)
  UNION ALL SELECT 'PLANT_XX', NULL)
SELECT tenant_id, COALESCE(config, '{}') AS config,
       CAST(json_extract(COALESCE(config, '{}'), '$.line') AS INTEGER) AS line
FROM c""")
def f12_config_json(fx):
    n = fx.raw("nation").select("n_nationkey")
    c = n.select(F.concat(F.lit("PLANT_"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
                 .alias("tenant_id"),
                 F.concat(F.lit('{"line":'), F.col("n_nationkey").cast("string"), F.lit("}"))
                 .alias("config"))
    c = c.unionByName(fx.spark.range(1).select(F.lit("PLANT_XX").alias("tenant_id"),
                                               F.lit(None).cast("string").alias("config")))
    return c.select("tenant_id", X.config_json(F.col("config")).alias("config"),
                    X.config_value(F.col("config"), "$.line", "int").alias("line"))


# ---------------------------------------------------------------- F13
@query("f13_sanitize_text", r"""
SELECT doc_id, regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '•', '-'), '–', '-'), '—', '--'), '‘', ''''), '’', ''''), '“', '"'), '”', '"'),
    '…', '...'), '°', ' deg'),
  '[^\x{00}-\x{FF}]', '?', 'g') AS text
FROM unicode_texts""", ("unicode_texts",))
def f13_sanitize_text(fx):
    u = fx.unicode_texts
    return u.select("doc_id", X.sanitize_text(F.col("text")).alias("text"))


# ---------------------------------------------------------------- F14
_RISK = """CASE WHEN pred <= 15 THEN 'Low' WHEN pred <= 30 THEN 'Medium'
                WHEN pred <= 45 THEN 'High' ELSE 'Critical' END"""


@query("f14_fallback_insights", f"""
WITH {_MACHINE_IN.strip()},
r AS (SELECT machine_id, pred, anomalies, {_RISK} AS risk FROM m)
SELECT machine_id,
  'AUTOMATED INSIGHTS (AI Unavailable):' || chr(10) || chr(10) || 'EXECUTIVE SUMMARY:' || chr(10)
  || 'The system predicts ' || printf('%.1f', pred) || ' minutes of downtime for the next shift with a '
  || lower(risk) || ' risk level. ' || chr(10)
  || CASE WHEN risk IN ('High', 'Critical') THEN 'Immediate attention required.' ELSE 'Monitoring recommended.' END
  || chr(10) || chr(10) || 'RISK ASSESSMENT:' || chr(10) || '- Current Risk Level: ' || risk || chr(10)
  || '- Predicted Downtime: ' || printf('%.1f', pred) || ' minutes' || chr(10)
  || '- Anomalies Detected: ' || CAST(anomalies AS VARCHAR) || chr(10) || chr(10) || 'RECOMMENDATIONS:' || chr(10)
  || CASE WHEN risk = 'Critical' THEN '1. URGENT: Schedule emergency maintenance immediately' || chr(10)
          || '2. Inspect all critical systems' || chr(10) || '3. Prepare backup equipment' || chr(10)
          WHEN risk = 'High' THEN '1. Schedule preventive maintenance within 24 hours' || chr(10)
          || '2. Monitor production closely' || chr(10) || '3. Review recent performance logs' || chr(10)
          ELSE '1. Continue normal operations' || chr(10) || '2. Maintain regular maintenance schedule'
          || chr(10) || '3. Monitor for pattern changes' || chr(10) END
  || CASE WHEN anomalies > 0 THEN chr(10) || 'ALERT: ' || CAST(anomalies AS VARCHAR)
          || ' anomalous patterns detected. Investigate unusual readings.' || chr(10) ELSE '' END
  AS full_analysis
FROM r""", P)
def f14_fallback_insights(fx):
    m = _machine_in(fx)
    risk = N.risk_level(F.col("pred"))
    return m.select("machine_id", N.fallback_insights(F.col("pred"), risk, F.col("anomalies"))
                    .alias("full_analysis"))


# ---------------------------------------------------------------- F15
@query("f15_sections", r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM analysis_texts)),
m AS (
  SELECT *, regexp_matches(trim(line), '^[1-5]\.') AS is_header,
         SUM(CASE WHEN regexp_matches(trim(line), '^[1-5]\.') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idx
  FROM lines),
h AS (SELECT doc_id, idx, lower(trim(regexp_extract(trim(line), '^[^.]*\.(.*)$', 1))) AS section
      FROM m WHERE is_header),
b AS (SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY pos) AS content
      FROM m WHERE NOT is_header GROUP BY doc_id, idx),
s AS (SELECT b.doc_id, b.idx, CASE WHEN b.idx = 0 THEN 'introduction' ELSE h.section END AS section,
             b.content
      FROM b LEFT JOIN h ON b.doc_id = h.doc_id AND b.idx = h.idx)
SELECT doc_id, section, arg_max(content, idx) AS content, CAST(max(idx) AS BIGINT) AS idx
FROM s GROUP BY doc_id, section""", ("analysis_texts",))
def f15_sections(fx):
    return X.text_sections(fx.analysis_texts)


# ---------------------------------------------------------------- F17
@query("f17_chart_insights", f"""
WITH {_TENANT_KPI.strip()},
r AS (
  SELECT tenant_id, 0 AS pos, 'production' AS section, 'Production Performance by Shift' AS title,
         'Total production across all shifts: ' || CAST(total_units AS VARCHAR)
         || ' units. Overall yield stands at ' || CAST(yield_pct AS VARCHAR)
         || '%, indicating strong quality control.' AS insight FROM k
  UNION ALL SELECT tenant_id, 1, 'downtime_trend', 'Downtime Trend Analysis',
         'Average downtime is ' || CAST(avg_downtime_min AS VARCHAR)
         || ' minutes per cycle. Monitor spikes to identify maintenance opportunities and improve OEE.' FROM k
  UNION ALL SELECT tenant_id, 2, 'downtime_by_machine', 'Machine-Level Downtime Comparison',
         'Machines with highest downtime require priority attention for maintenance scheduling. '
         || 'Total defective units: ' || CAST(total_defects AS VARCHAR) || ', focus on quality improvements.' FROM k
  UNION ALL SELECT tenant_id, 3, 'ml', 'Machine Learning Analysis Dashboard',
         'ML Model Confidence: N/A. Risk Level: Medium. Anomalies detected: 0. Predicted downtime: N/A.' FROM k
  UNION ALL SELECT tenant_id, 4, 'forecast', 'Advanced Time-Series Forecasting',
         'Next period forecast: N/A. 7-day average forecast: N/A. Use these predictions for proactive resource planning.' FROM k)
SELECT tenant_id, CAST(pos AS INTEGER) AS pos, section, title, insight FROM r""", P)
def f17_chart_insights(fx):
    k = _tenant_kpi(fx)
    na = F.lit(None)
    arr = N.chart_insights(F.col("total_units"), F.col("yield_pct"),
                           F.col("avg_downtime_min"), F.col("total_defects"),
                           na, na, na, na, na, na)
    return (k.select("tenant_id", F.posexplode(arr).alias("pos", "r"))
            .select("tenant_id", "pos", "r.section", "r.title", "r.insight"))


# ---------------------------------------------------------------- K6
@query("k6_metric_sheet", f"""
WITH {_TENANT_KPI.strip()}
SELECT tenant_id, metric, value FROM (
  SELECT tenant_id, 'Total Units' AS metric, CAST(total_units AS VARCHAR) AS value FROM k
  UNION ALL SELECT tenant_id, 'Total Defects', CAST(total_defects AS VARCHAR) FROM k
  UNION ALL SELECT tenant_id, 'Yield %', CAST(yield_pct AS VARCHAR) FROM k
  UNION ALL SELECT tenant_id, 'Avg Downtime (min)', CAST(avg_downtime_min AS VARCHAR) FROM k)""", P)
def k6_metric_sheet(fx):
    from ..sources.sinks import metric_sheet
    k = _tenant_kpi(fx)
    return metric_sheet(k, ["tenant_id"], {
        "Total Units": "total_units", "Total Defects": "total_defects",
        "Yield %": "yield_pct", "Avg Downtime (min)": "avg_downtime_min"})


# ---------------------------------------------------------------- O4
@query("o4_sample_head", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, production_date, machine_id, units_produced
FROM production
ORDER BY production_date, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20""", P)
def o4_sample_head(fx):
    from ..sources.fixtures import ORDER_COLS
    return (fx.production.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                 "production_date", "machine_id", "units_produced")
            .orderBy(*ORDER_COLS).limit(20))
