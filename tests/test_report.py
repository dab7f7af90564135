"""C4 batch report end to end on the smallest tables (slow: trains the models)."""
import json
import os

from pyspark.sql import functions as F

from millrace.operators.common import last_day
from millrace.plans.report import run_report


def test_run_report(spark, fx, tmp_dir):
    as_of = last_day(fx.production)
    live = fx.live_records.limit(30)
    paths = run_report(fx.production, live, os.path.join(tmp_dir, "report"), 30, as_of)
    sheet = {r.metric: r.value for r in spark.read.parquet(paths["metric_sheet"]).collect()}
    assert int(sheet["Total Units"]) > 0
    assert sheet["Risk Level"] in {"Low", "Medium", "High", "Critical", "Unknown"}
    assert sheet["ML Predicted Downtime"].endswith(" min")
    recs = spark.read.parquet(paths["recommendations"]).orderBy("pos").collect()
    assert recs[-1].line.startswith("- Review detailed analytics")
    log = spark.read.text(paths["validation_log"]).collect()
    assert log
    fc = spark.read.parquet(paths["forecast"])
    assert fc.filter(F.col("model") == "ensemble").count() == 7
    assert spark.read.parquet(paths["chart_insights"]).count() == 5
    blocks = [json.loads(r.value) for r in spark.read.text(paths["insights"]).collect()]
    assert list(blocks[0]) == ["strategic_insights", "maintenance_plan", "quality_insights", "analysis_context"]
    assert json.loads(blocks[0]["analysis_context"])["data_quality"]["samples_analyzed"] > 0


def test_insight_bundle_content(spark, fx):
    import json

    import __spark_entry__ as entry
    from conftest import SF_SMALL
    rows = entry.queries()["c3_insight_bundle"](spark, SF_SMALL).collect()
    assert len(rows) == fx.production.select("tenant_id").distinct().count()
    for r in rows:
        assert r.full_analysis.startswith("AUTOMATED INSIGHTS")
        assert r.sections["summary"] == r.full_analysis
        ctx = json.loads(r.context_json)
        assert ctx["kpi_summary"]["total_units"] == r.total_units
        assert r.risk_level in {"Low", "Medium", "High", "Critical"}
