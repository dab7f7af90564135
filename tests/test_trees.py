"""Forests and boosted trees of many groups; insight records per tenant."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ml, trees

COLS = ["a", "b", "c"]
SCHEMA = "grp string, row_id long, is_train boolean, a double, b double, c double, y double"


def plant_rows(groups=("p", "q"), n=240, seed=5):
    r, rows = random.Random(seed), []
    for k, g in enumerate(groups):
        for i in range(n):
            a, b, c = r.randint(0, 40), r.random() * 10, float(r.randint(0, 3))
            rows.append((g, i, r.random() < 0.8, float(a), b, c, (10 + k) * (a > 20) + 3 * b + r.gauss(0, 0.3)))
    return rows


@pytest.fixture(scope="module")
def plants(spark):
    return spark.createDataFrame(plant_rows(), SCHEMA)


def test_small_and_large_groups_grow_the_same_trees(spark, plants):
    size = dict(rounds=2, trees=3, bins=12)
    got = []
    for local_rows in (10_000, 0):
        rows, shares = trees.train_groups(plants, COLS, "grp", "y", local_rows=local_rows, **size)
        got.append(({(r.grp, r.row_id): (r.forest_pred, r.boost_pred) for r in rows.collect()},
                    {(r.grp, r.feature): r.importance for r in shares.collect()}))
    (rows, shares), (wide_rows, wide_shares) = got
    assert len(rows) == 480 and rows.keys() == wide_rows.keys() and shares.keys() == wide_shares.keys()
    assert all(np.allclose(rows[k], wide_rows[k], atol=1e-9) for k in rows)
    assert all(abs(shares[k] - wide_shares[k]) < 1e-9 for k in shares)
    assert sum(v for (g, _), v in shares.items() if g == "p") == pytest.approx(1.0)


def test_held_out_rows_are_predicted(spark, plants):
    rows, shares = trees.train_groups(plants, COLS, "grp", "y")
    held = plants.filter("NOT is_train").join(rows, ["grp", "row_id"])
    for r in held.groupBy("grp").agg(ml.r2(F.col("y"), F.col("forest_pred")).alias("f"),
                                     ml.r2(F.col("y"), F.col("boost_pred")).alias("b")).collect():
        assert r.f > 0.95 and r.b > 0.95
    top = {r.grp: r.feature for r in shares.orderBy("importance").collect()}
    assert set(top.values()) <= {"a", "b"}


def best_by_hand(bins, g, reg=1.0):
    """Try every cut of every feature of one node."""
    found = []
    for f in range(bins.shape[1]):
        for b in sorted(set(bins[:, f]))[:-1]:
            left = bins[:, f] <= b
            gl, gr, hl, hr = g[left].sum(), g[~left].sum(), left.sum(), (~left).sum()
            gain = round((gl ** 2 / (hl + reg) + gr ** 2 / (hr + reg) - g.sum() ** 2 / (len(g) + reg)) / 2, 6)
            found.append((-gain, f, b))
    return min(found)


def test_first_split_is_the_best_cut(spark):
    r = np.random.default_rng(1)
    for _ in range(20):
        bins, y = r.integers(0, 6, (50, 3)), r.normal(size=50)
        g = y.mean() - y
        gain, f, b = best_by_hand(bins, g)
        df = spark.createDataFrame([("p", [int(x) for x in row], float(v), 1.0) for row, v in zip(bins, g)],
                                   "grp string, bins array<int>, g double, h double") if _ < 3 else None
        value = trees.grow_local(bins, g, np.ones(50), 1, 1.0)
        left = bins[:, f] <= b
        want = np.where(left, -g[left].sum() / (left.sum() + 1), -g[~left].sum() / ((~left).sum() + 1))
        assert np.allclose(value, want)
        if df is not None:
            s = trees.best_splits(trees.split_gains(trees.node_sums(df.withColumn("node", F.lit(1)), ["grp"]), ["grp"]), ["grp"]).first()
            assert (s.feature, s.bin, s.gain) == (f, b, pytest.approx(-gain))


def test_equal_gains_take_the_first_feature_and_bin():
    bins = np.array([[0, 0], [0, 0], [2, 2], [2, 2]])
    gains = np.zeros(2)
    trees.grow_local(bins, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4), 3, 1.0, gains)
    assert gains[0] > 0 and gains[1] == 0


def test_odd_groups(spark):
    rows = [("one", 1, True, 1.0, 1.0, 1.0, 7.0), ("none", 1, False, 1.0, 1.0, 1.0, 7.0),
            ("flat", 1, True, 1.0, 1.0, 1.0, 2.0), ("flat", 2, True, 1.0, 1.0, 1.0, 4.0), ("flat", 3, False, 9.0, None, 1.0, None),
            ("null", 1, True, None, None, None, 5.0), ("null", 2, True, None, None, None, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for local_rows in (100, 0):
        got, shares = trees.train_groups(df, COLS, "grp", "y", rounds=2, trees=2, local_rows=local_rows)
        pred = {(r.grp, r.row_id): r.boost_pred for r in got.collect()}
        assert pred[("one", 1)] == 7 and pred[("none", 1)] == 0 and pred[("flat", 3)] == 3 and pred[("null", 2)] == 5
        assert len(pred) == len(rows) and shares.agg(F.sum("importance")).first()[0] == 0


def test_tenant_records(spark, fx):
    from millrace.plans.report import tenant_models, tenant_records
    from millrace.sources.fixtures import ORDER_COLS
    keys = ORDER_COLS[1:]
    big, other, small = [r.tenant_id for r in fx.production.groupBy("tenant_id").count().orderBy(F.desc("count")).take(3)]
    quiet = fx.production.filter(F.col("tenant_id") == small).orderBy(*ORDER_COLS).limit(4)
    rows = fx.production.filter(F.col("tenant_id").isin(big, other)).unionByName(quiet)
    models = tenant_models(rows, keys, ORDER_COLS, rounds=20, trees=10)
    got = {r.tenant_id: r for r in tenant_records(fx.tenants, rows, *models).collect()}
    assert len(got) == fx.tenants.count()
    for t, r in got.items():
        if t in (big, other):
            assert r.prediction == pytest.approx(0.4 * r.forest_pred + 0.6 * r.boost_pred)
            assert sum(r.feature_importance.values()) == pytest.approx(1) and len(r.feature_importance) == 8
            assert r.anomalies_detected > 0 and r.boost_r2 > 0.5
        else:       # four rows are too few, and the rest have none
            assert (r.prediction, r.confidence, r.anomalies_detected, r.feature_importance) == (0, 0, 0, {})
            assert r.risk_level == "Low" and r.recommendations == []


def test_bins_are_the_edges_below_without_a_lambda(spark):
    rows = [("p", float(i % 9), i / 7 - 3 if i % 6 else None) for i in range(60)] + [("q", 2.0, float("nan")), ("q", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "grp string, a double, b double")
    for method in ("width", "quantile"):
        at = df.join(trees.bin_edges(df, ["a", "b"], "grp", 8, method), "grp")

        def below(k, c):
            return F.coalesce(F.size(F.filter(F.col("edges")[k], lambda e: e < F.col(c))), F.lit(0))
        bins = at.select(trees.binned(at, ["a", "b"]).alias("x"))
        assert "lambda" not in bins._jdf.queryExecution().analyzed().toString().split("Aggregate")[0]
        both = at.select(trees.binned(at, ["a", "b"]).alias("x"), F.array(below(0, "a"), below(1, "b")).alias("y")).collect()
        assert len(both) == len(rows) and all(list(r.x) == list(r.y) for r in both)
