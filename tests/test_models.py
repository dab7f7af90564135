"""Windows vs plain windows, anomaly planted outliers, forecasts on known signals."""
import datetime as dt

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import anomaly, forecast, kpi, ml, windows


def test_block_halo_matches_plain_window(spark):
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(days=d), i, float((i * 7 + d) % 11))
            for m in ("A", "B") for d in range(6) for i in range(d % 3 + 1)]
    df = spark.createDataFrame(rows, "m string, production_date date, k int, v double")
    got = windows.trailing_means(df, ["m"], ["production_date", "k"], {"ma": "v"}, 3)
    w = Window.partitionBy("m").orderBy("production_date", "k").rowsBetween(-2, 0)
    want = df.withColumn("ma", F.avg("v").over(w))
    assert got.select("m", "production_date", "k", "ma").exceptAll(
        want.select("m", "production_date", "k", "ma")).count() == 0
    lags = windows.lag_features(df, ["m"], ["production_date", "k"], "v", 4, keep_partial=True)
    w2 = Window.partitionBy("m").orderBy("production_date", "k")
    ref = df.withColumns({f"lag_{j}": F.lag("v", j).over(w2) for j in range(1, 5)})
    cols = ["m", "production_date", "k"] + [f"lag_{j}" for j in range(1, 5)]
    assert lags.select(*cols).exceptAll(ref.select(*cols)).count() == 0


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(0, 1, size=(900, 3))
    planted = rng.normal(8, 0.5, size=(100, 3))
    x = np.vstack([normal, planted])
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    flags = anomaly.detect_anomalies(df, ["a", "b", "c"], ["id"], trees=50, psi=128)
    flagged = {r.id for r in flags.filter("is_anomaly").select("id").collect()}
    assert 90 <= len(flagged) <= 110
    assert len(flagged & set(range(900, 1000))) >= 90


def test_trend_weekday_recovers_weekly_pattern(spark):
    start = dt.date(2024, 1, 1)
    pattern = [1.0, 4.0, 2.0, 3.0, 2.0, 4.0, 1.0]   # uncorrelated with t over whole weeks
    rows = [("A", start + dt.timedelta(days=d), 10.0 + 0.5 * d + pattern[d % 7])
            for d in range(70)]
    daily = spark.createDataFrame(rows, "machine_id string, production_date date, y double")
    fc = forecast.trend_forecast(daily, ["machine_id"], 7, include_history=False) \
                 .orderBy("step").collect()
    for r in fc:
        d = (r.ds - start).days
        assert abs(r.yhat - (10.0 + 0.5 * d + pattern[d % 7])) < 1e-6


def test_ar_fits_linear_signal(spark):
    start = dt.date(2024, 1, 1)
    rows = [("A", start + dt.timedelta(days=d), 0.9 ** (d % 20) * 10 + 1.0, 1)
            for d in range(200)]
    daily = spark.createDataFrame(rows, "machine_id string, production_date date, y double, n_rows long")
    coefs = forecast.fit_ar(daily, ["machine_id"])
    state = forecast.ar_state(daily, ["machine_id"])
    fc = forecast.recursive_forecast(state, coefs, ["machine_id"], 7).orderBy("step").collect()
    assert len(fc) == 7 and all(np.isfinite(r.yhat) for r in fc)


def test_r2_and_ensemble(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "y double, p double")
    r = df.select(ml.r2(F.col("y"), F.col("p"))).first()[0]
    ss_res = 0.01 + 0.01 + 0.04
    assert abs(r - (1 - ss_res / 2.0)) < 1e-12
    e = ml.ensemble_columns(df, F.col("y"), F.col("p")).first()
    assert abs(e.ensemble_pred - (0.4 * 1.0 + 0.6 * 1.1)) < 1e-12


def test_changepoint_model_follows_a_trend_break(spark):
    start = dt.date(2024, 1, 1)
    pattern = [1.0, 4.0, 2.0, 3.0, 2.0, 4.0, 1.0]
    rows = [("A", start + dt.timedelta(days=d),
             (20.0 + 0.2 * d if d < 60 else 32.0 - 0.1 * (d - 60)) + pattern[d % 7])
            for d in range(120)]
    daily = spark.createDataFrame(rows, "machine_id string, production_date date, y double")
    fc = forecast.changepoint_forecast(daily, ["machine_id"], 7).filter("step > 0") \
                 .orderBy("step").collect()
    assert len(fc) == 7
    for r in fc:
        d = (r.ds - start).days
        want = 32.0 - 0.1 * (d - 60) + pattern[d % 7]
        assert abs(r.yhat - want) < 1.5, (d, r.yhat, want)
        assert r.lower <= r.yhat <= r.upper


def test_two_breaks_are_found_sparsely_and_bands_cover(spark):
    rng = np.random.default_rng(3)
    start = dt.date(2023, 1, 1)

    def level(d):
        return 30 + 0.1 * d - 0.25 * max(d - 80, 0) + 0.3 * max(d - 160, 0)

    rows = [(f"S{k:02d}", start + dt.timedelta(days=d), level(d) + float(rng.normal(0, 1.0)))
            for k in range(30) for d in range(247)]
    full = spark.createDataFrame(rows, "machine_id string, production_date date, y double")
    daily = full.filter(F.col("production_date") < start + dt.timedelta(days=240))
    fits = forecast.changepoint_fits(daily, ["machine_id"]).toPandas()
    for _, f in fits.iterrows():
        at, size = np.array(f.changepoints) * f.span, np.array(f.deltas)
        big = np.abs(size) > 0.1 * np.abs(size).max()
        assert (size == 0).sum() >= 12, size
        assert all(min(abs(a - 80), abs(a - 160)) <= 25 for a in at[big]), at[big]
    fc = forecast.changepoint_forecast(daily, ["machine_id"]).filter("step > 0")
    hit = fc.join(full.withColumnRenamed("production_date", "ds"), ["machine_id", "ds"]).select(
        F.avg((F.col("y").between(F.col("lower"), F.col("upper"))).cast("int"))).first()[0]
    assert 0.65 <= hit <= 0.95, hit
    wide = fc.groupBy("step").agg(F.avg(F.col("upper") - F.col("lower")).alias("w")).orderBy("step").collect()
    assert wide[6].w > wide[0].w * 0.98
    checked = forecast.changepoint_optimality(daily, spark.createDataFrame(fits, forecast.changepoint_fits(
        daily, ["machine_id"]).schema), ["machine_id"]).collect()
    assert len(checked) == 30 and all(r.optimal and r.n_changepoints == 25 for r in checked)


def test_sparse_solve_is_the_minimum():
    rng = np.random.default_rng(5)
    for n in (1, 3, 12):
        a = rng.normal(size=(n + 4, n))
        s, c, lam = a.T @ a, rng.normal(size=n) * 3, 0.8
        x = forecast.sparse_solve(s, c, lam)
        z = np.zeros(n)
        for _ in range(20000):        # proximal gradient, slow and simple
            v = z - (s @ z - c) / np.linalg.norm(s, 2)
            z = np.sign(v) * np.maximum(np.abs(v) - lam / np.linalg.norm(s, 2), 0)
        assert np.abs(x - z).max() < 1e-6
    assert len(forecast.sparse_solve(np.zeros((0, 0)), np.zeros(0), 1.0)) == 0


def test_short_and_constant_series_have_fits(spark):
    start = dt.date(2024, 1, 1)
    rows = [(m, start + dt.timedelta(days=d), v) for m, n, v in (("short", 11, 2.0), ("flat", 40, 3.0), ("tiny", 5, 1.0))
            for d in range(n)]
    daily = spark.createDataFrame(rows, "machine_id string, production_date date, y double")
    ar = {r.machine_id: r for r in forecast.fit_ar(daily, ["machine_id"]).collect()}
    assert set(ar) == {"short", "flat"} and ar["short"].n_train == 1
    assert all(np.isfinite([r.intercept, *r.coef]).all() for r in ar.values())
    fc = forecast.changepoint_forecast(daily, ["machine_id"]).filter("step > 0").collect()
    assert {r.machine_id for r in fc} == {"short", "flat"}
    for r in fc:
        assert abs(r.yhat - (2.0 if r.machine_id == "short" else 3.0)) < 0.05


def test_ar_matches_numpy(spark):
    rng = np.random.default_rng(1)
    start = dt.date(2024, 1, 1)
    y = rng.normal(size=120).cumsum()
    daily = spark.createDataFrame([("A", start + dt.timedelta(days=d), float(v)) for d, v in enumerate(y)],
                                  "machine_id string, production_date date, y double")
    got = forecast.fit_ar(daily, ["machine_id"]).first()
    ys = (y - y.min()) / (y.max() - y.min())
    x = np.array([[1.0, *ys[i - 10:i]] for i in range(10, 120)])[:88]
    want = np.linalg.solve(x.T @ x + np.diag([0.0] + [1e-6] * 10), x.T @ ys[10:98])
    assert got.n_train == 88 and np.abs(np.array([got.intercept, *got.coef]) - want).max() < 1e-7


def test_bootstrap_interval(spark):
    rows = [("a", i, float(i % 10)) for i in range(400)] + [("b", 1, 5.0), ("c", 2, None), (None, 3, 1.0), (None, 4, 3.0)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    out = {r.g: r for r in kpi.bootstrap_interval(df, ["g"], "v", ["g", "k"]).collect()}
    assert set(out) == {"a", "b", None}
    a = out["a"]
    se = 2.8723 / 20
    assert a.n == 400 and a.mean == 4.5 and abs((a.upper - a.lower) / (2 * 1.96 * se) - 1) < 0.3
    assert a.lower < 4.5 < a.upper and out["b"].lower == out["b"].upper == 5.0
    again = {r.g: r for r in kpi.bootstrap_interval(df.repartition(5), ["g"], "v", ["g", "k"]).collect()}
    assert again == out


def test_hot_blocks_give_the_same_windows(spark, monkeypatch):
    rows = [(m, dt.date(2024, 1, 1 + d) if d else None, i // 3, i, float((i * 7 + d) % 11))
            for m in ("A", "B", None) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "m string, production_date date, o int, k int, v double")
    order = ["production_date", "o", "k"]

    def results():
        a = windows.trailing_means(df, ["m"], order, {"ma": "v"}, 4)
        return sorted(map(str, windows.chrono_split(a, ["m"], order).collect()))

    plain = results()
    assert len(plain) == len(rows)
    monkeypatch.setattr(windows, "HOT_BLOCK_ROWS", 5)
    assert results() == plain
    w = Window.partitionBy("m").orderBy(*order).rowsBetween(-3, 0)
    want = df.withColumn("ma", F.avg("v").over(w)).select("m", "o", "k", "production_date", "ma")
    got = windows.trailing_means(df, ["m"], order, {"ma": "v"}, 4).select("m", "o", "k", "production_date", "ma")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_exact_quantile_with_ties(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.random(1001), "b": np.round(rng.random(400), 1), "c": np.array([0.5]), "d": np.full(50, 0.25),
              "e": 0.5 + rng.random(300) * 1e-9}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    for q in (0.9, 0.0, 1.0, 0.333):
        got = {r.g: (r.cut, r.n) for r in anomaly.exact_quantile(df, "v", q, ["g"]).collect()}
        for g, v in groups.items():
            assert abs(got[g][0] - np.percentile(v, q * 100)) < 1e-12 and got[g][1] == len(v)


def test_flags_do_not_depend_on_partitions_or_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, f"t{i % 400}", *map(float, rng.normal(size=2))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, t string, a double, b double")

    def flags(d):
        got = anomaly.detect_anomalies(d, ["a", "b"], ["id"], ["t"], trees=10, psi=8)
        return {r.id for r in got.filter("is_anomaly").collect()}

    first = flags(df)
    assert 350 <= len(first) <= 400          # the top one of 10 rows a tenant, less ties
    monkeypatch.setattr(anomaly, "SLICE_ROWS", 3)
    assert flags(df.repartition(7)) == first


def test_pruned_window_plan(spark, fx):
    plan = fx.recent(7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_no_analysis_below_the_gate(spark):
    from millrace.plans.report import no_analysis
    r = no_analysis(spark).record.first()
    assert (r.prediction, r.anomalies_detected, r.feature_importance) == (0.0, 0, {})


def test_upsert_without_sequence_refuses_repeated_keys(spark):
    import pytest

    from millrace.operators import tenancy
    once = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert tenancy.latest_per_key(once, ["k"], None, ["v"]).count() == 2
    with pytest.raises(Exception, match="seq"):
        tenancy.latest_per_key(once.union(once), ["k"], None, ["v"]).collect()


def test_series_that_fit_a_task_move_once(spark, monkeypatch):
    rows = [(m, dt.date(2024, 1, 1 + i % 3) if i % 5 else None, i, float(i * 7 % 11) if i % 4 else None)
            for m, n in (("A", 40), ("B", 9), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "m string, production_date date, k int, v double")
    order = ["production_date", "k"]

    def results():
        means = windows.trailing_means(df, ["m"], order, {"ma": "v"}, 3)
        split = windows.chrono_split(means, ["m"], order)
        return split, sorted(map(str, split.collect() + windows.lag_features(df, ["m"], order, "v", 2).collect()))

    split, plain = results()
    plan = split._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Sort ") <= 1
    assert results()[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    monkeypatch.setattr(windows, "HOT_BLOCK_ROWS", 10)       # A and the null machine in blocks, B whole
    assert results()[1] == plain
    w = Window.partitionBy("m").orderBy(*order).rowsBetween(-2, 0)
    want = df.withColumn("ma", F.avg("v").over(w)).select(*df.columns, "ma")
    assert split.select(*df.columns, "ma").exceptAll(want).count() == 0


def test_path_sums_are_those_of_a_walk_down_each_tree(monkeypatch):
    from types import SimpleNamespace
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 3)), 1)
    x[::50, 1] = np.nan
    trees = anomaly.grow_forest(x[1:], np.stack([rng.choice(650, 64, replace=False) for _ in range(10)]), rng, 6)
    run = SimpleNamespace(**anomaly._pack(trees, 64))
    want = np.zeros(len(x))
    for i, row in enumerate(x):
        lengths = []
        for _, nodes in trees.groupby("tree"):
            node, depth = nodes.set_index("node"), 0
            at = node.loc[0]
            while at.feature >= 0:
                at, depth = node.loc[at.left if row[int(at.feature)] < at.threshold else at.right], depth + 1
            lengths.append(depth + anomaly.c_factor(at["size"]))
        want[i] = np.array(lengths).sum()
    monkeypatch.setattr(anomaly, "SCORE_ROWS", 256)
    got, many = anomaly._path_sums(x, run)
    assert many == 10 and np.array_equal(got, want)


def test_scores_carry_only_what_is_asked_for(spark):
    rows = [(i, f"t{i % 2}", float(i % 13), float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, a double, b double")
    full = anomaly.detect_anomalies(df, ["a", "b"], ["id"], ["t"], trees=10, psi=8)
    some = anomaly.detect_anomalies(df, ["a", "b"], ["id"], ["t"], trees=10, psi=8, keep=["id"], stored=True)
    assert set(full.columns) == {"id", "t", "a", "b", "iforest_score", "is_anomaly"}
    assert set(some.columns) == {"id", "iforest_score", "is_anomaly"}
    assert sorted(some.collect()) == sorted(full.select(*some.columns).collect())


def test_bootstrap_sums_are_not_exploded(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"g{int(g)}" if g else None, i, float(v)) for i, (g, v) in
            enumerate(zip(rng.integers(0, 6, 900), rng.integers(0, 50, 900)))]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    out = kpi.bootstrap_interval(df, ["g"], "v", ["g", "k"])
    assert "MapInPandas" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r for r in out.collect()}
    key = F.concat_ws(":", F.coalesce("g", F.lit("")), F.col("k").cast("string"))
    seeds = df.select("g", "v", (F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
                                 % (kpi.PRIME - 1) + 1).alias("s")).collect()
    for g, r in got.items():
        w = np.array([[sum(x.s * a % kpi.PRIME >= c for c in kpi.poisson_cuts()) for a in kpi.draw_steps()]
                      for x in seeds if x.g == g])
        v = np.array([x.v for x in seeds if x.g == g])
        means = (v[:, None] * w).sum(axis=0) / w.sum(axis=0)
        assert r.n == len(v) and abs(r.mean - v.mean()) < 1e-12
        assert np.allclose([r.lower, r.upper], np.percentile(means, [2.5, 97.5]), atol=1e-12)
    monkeypatch.setattr(kpi, "BOOT_ROWS", 7)
    assert {r.g: r for r in kpi.bootstrap_interval(df.repartition(7), ["g"], "v", ["g", "k"]).collect()} == got


def test_a_window_of_nulls_has_a_null_mean(spark, monkeypatch):
    df = spark.createDataFrame([("A", dt.date(2024, 1, d), d, None if d < 5 else 2.0) for d in range(1, 8)],
                               "m string, production_date date, k int, v double")
    want = [None] * 4 + [2.0] * 3
    for limit in (100, 3):
        monkeypatch.setattr(windows, "HOT_BLOCK_ROWS", limit)
        got = windows.trailing_means(df, ["m"], ["production_date", "k"], {"ma": "v"}, 3).orderBy("k").collect()
        assert [r.ma for r in got] == want


def test_features_are_derived_after_the_rows_have_moved(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, d), d, float(d), 1.0, None if d == 4 else 2.0 * d) for d in range(1, 8)],
                               "m string, production_date date, k int, units_produced double, defective_units double, downtime_min double")
    out = ml.features(df, ["m"], ["production_date", "k"])
    assert out.columns == [*df.columns, "defect_rate", "quality_score", "production_efficiency", "units_ma3", "defects_ma3", "downtime_trend"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window [")
    # neither ratios in the shuffle nor sliding frames, which are summed anew for every row
    assert "defect_rate" in plan[:window] and "defect_rate" not in plan[window:] and "avg(" not in plan
    got = {r.k: r for r in out.collect()}
    assert [got[k].units_ma3 for k in (1, 2, 3, 7)] == [1.0, 1.5, 2.0, 6.0]
    assert [got[k].downtime_trend for k in (3, 4, 5, 6)] == [4.0, 5.0, 8.0, 11.0]
    assert got[3].defect_rate == 0.25 and got[3].production_efficiency == 3 / 7 and got[4].production_efficiency == 0.0
