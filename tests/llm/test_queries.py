"""Registered training-data queries: SQL oracles and the pipeline's shape."""
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck


def llm_oracles():
    from millrace.llm.queries import ORACLES
    return ORACLES


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_oracle(spark, name):
    res = compare(entry.queries()[name](spark, SF_SMALL), duck(SF_SMALL), llm_oracles()[name])
    assert res["ok"], res


def test_all_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from millrace.llm.common import materialize
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_SMALL), "test-stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    assert docs.filter(docs.text.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9]")).count() == 0
    out = cp.STAGES[-1][1](spark, docs, SF_SMALL)
    assert out.count() == counts[4]
    assert out.filter("taken > 3 * size").count() == 0
