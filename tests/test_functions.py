"""Bands at and around thresholds, text formatting, sanitising, sections."""
from pyspark.sql import functions as F

from millrace.functions import narrative as N
from millrace.functions import text as X


def _one(spark, expr, value, typ="double"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("r")).first().r


def test_risk_bands(spark):
    cases = {0.0: "Low", 15.0: "Low", 15.01: "Medium", 30.0: "Medium", 30.5: "High",
             45.0: "High", 45.1: "Critical"}
    for v, want in cases.items():
        assert _one(spark, N.risk_level, v) == want, v
    basic = {20.0: "Low", 20.1: "Medium", 40.0: "Medium", 40.1: "High"}
    for v, want in basic.items():
        assert _one(spark, N.basic_risk, v) == want, v


def test_quality_and_downtime_bands(spark):
    assert _one(spark, N.quality_band, 99.0).startswith("Excellent")
    assert _one(spark, N.quality_band, 98.99).startswith("Good")
    assert _one(spark, N.quality_band, 95.0).startswith("Acceptable")
    assert _one(spark, N.quality_band, 94.9).startswith("Below")
    assert _one(spark, N.downtime_band, 9.99).startswith("Optimal")
    assert _one(spark, N.downtime_band, 10.0).startswith("Moderate")
    assert _one(spark, N.downtime_band, 29.9).startswith("Elevated")
    assert _one(spark, N.downtime_band, 30.0).startswith("Critical")


def test_python_style_fixed_point(spark):
    for v in [0.25, 12.25, 12.75, 0.15, 2.675, 28.45, -1.25, 100.0, 1e-9]:
        assert _one(spark, lambda c: X.py_fixed(c, 1), v) == f"{v:.1f}", v
        assert _one(spark, lambda c: X.py_fixed(c, 2), v) == f"{v:.2f}", v
    assert _one(spark, X.thousands, 1234567, "long") == "1,234,567"


def test_sanitize(spark):
    s = "•–—‘’“”…°你😀é"
    want = "----''\"\"... deg??é"
    assert _one(spark, X.sanitize_text, s, "string") == want


def test_sections(spark):
    text = "\n".join(["intro a", "intro b", "1. Summary", "s1", "2. Empty",
                      "  3.  Plan ", "p1", "p2", "4. Plan", "p3", "5. Tail"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.section: r.content for r in X.text_sections(df).collect()}
    assert got == {"introduction": "intro a\nintro b", "summary": "s1", "plan": "p3"}
    m = X.sections_map(X.text_sections(df)).first().sections
    assert m["plan"] == "p3"


def test_fallback_text_shape(spark):
    df = spark.createDataFrame([(50.0, 3)], "p double, a int")
    t = df.select(N.fallback_insights(F.col("p"), N.risk_level(F.col("p")), F.col("a"))).first()[0]
    assert "predicts 50.0 minutes" in t and "critical risk level" in t
    assert "1. URGENT" in t and "ALERT: 3 anomalous" in t


def test_report_recommendations_defaults(spark):
    df = spark.createDataFrame([(99.0, 5.0, 0)], "y double, d double, a int")
    recs = df.select(N.report_recommendations(F.col("y"), F.col("d"), F.col("a"))).first()[0]
    assert recs[0] == N.REC_DEFAULTS[0] and len(recs) == 4
