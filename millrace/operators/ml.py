"""Downtime model: features, scaling, forest + boosted ensemble (M1-M10,
M12-M14).

Feature engineering, scaling and scoring are column expressions over the
whole table; training uses ``pyspark.ml`` estimators (distributed tree
induction). Nothing row-level passes through the driver: only fitted
models and their small summaries (8 importances, 8 means/stds) do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import narrative as N
from ..sources.schemas import DISPLAY_NAMES
from . import windows
from .common import AsOf, trailing_window

# The model's feature names (reference display names) and the
# storage columns they are computed into.
FEATURES = {
    "units_produced": "Units Produced",
    "defective_units": "Defective Units",
    "defect_rate": "Defect_Rate",
    "quality_score": "Quality_Score",
    "production_efficiency": "Production_Efficiency",
    "units_ma3": "Units_MA3",
    "defects_ma3": "Defects_MA3",
    "downtime_trend": "Downtime_Trend",
}
LEAKY = ["production_efficiency", "downtime_trend"]   # computed from the label
LABEL = "downtime_min"
RF_PARAMS = dict(numTrees=100, maxDepth=10, seed=42, featureSubsetStrategy="all")
GB_PARAMS = dict(maxIter=100, maxDepth=6, stepSize=0.1, seed=42)
ENSEMBLE_WEIGHTS = (0.4, 0.6)
# execution-only settings (same trees): cache node ids between levels and
# give each pass more room for node statistics (fewer passes per level)
TRAIN_EXEC = dict(cacheNodeIds=True, maxMemoryInMB=1024)


def derived_features(df: DataFrame) -> DataFrame:
    """F1 defect rate, quality score, production efficiency (+1 guards)."""
    u, d, t = F.col("units_produced"), F.col("defective_units"), F.col("downtime_min")
    return df.withColumns({
        "defect_rate": d / (u + 1),
        "quality_score": 1 - d / (u + 1),
        "production_efficiency": u / (t + 1),
    })


def features(df: DataFrame, series: list[str], order: list[str],
             block: list[str] | None = None, drop_leaky: bool = False) -> DataFrame:
    """M1 the eight features + label, per series (rolling means need >= 5 rows)."""
    means = {"units_ma3": "units_produced", "defects_ma3": "defective_units", "downtime_trend": "downtime_min"}
    out = windows.trailing_means(df, series, order, means, window=3, block=block, min_rows=5)
    # derived after the rows have moved: the shuffle and the sort carry the measures only
    names = derived_features(df).columns
    out = derived_features(out).select(*names, *[c for c in means if c not in names])
    out = out.na.fill(0.0, subset=list(FEATURES))
    if drop_leaky:
        out = out.drop(*LEAKY)
    return out


def feature_cols(df: DataFrame) -> list[str]:
    return [c for c in FEATURES if c in df.columns]


def hash_split(df: DataFrame, keys: list[str], train_pct: int = 80, seed: int = 42) -> DataFrame:
    """M2 stable random split: the md5 of ``seed|keys``, first 32 bits, modulo
    100, under ``train_pct``.

    Unlike ``randomSplit`` it does not depend on partitioning, so a retried
    task or a re-read table gives the same split, in any engine with md5.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_train", h % 100 < train_pct)


def model_input(prod: DataFrame, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """S11 the model routes' input: the window's date and three measures under
    their display names, in date order."""
    cols = ["production_date", "units_produced", "defective_units", "downtime_min"]
    rows = trailing_window(prod, days, as_of).orderBy("production_date")
    return rows.select(*[F.col(c).alias(DISPLAY_NAMES[c]) for c in cols])


@dataclass
class Scaler:
    """M3 standardisation fitted on a frame (population std, centred)."""
    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "_z") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(self.stds[c] or 1.0)
            for c, m in self.means.items()})


def scaling_stats(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """M3 per-group mean and population std (zero std -> scale 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*(group or [])).agg(*aggs)


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                group: list[str] | None = None, suffix: str = "_z",
                stats: DataFrame | None = None) -> DataFrame:
    """M3 z-scores fitted on ``fit_on`` (default: ``df``), optionally per group,
    or by given ``stats`` (of ``scaling_stats``).

    The statistics are one row per group, joined back (broadcast by AQE from
    measured size); no collect.
    """
    if stats is None:
        stats = scaling_stats(fit_on if fit_on is not None else df, cols, group)
    if group:
        joined = df.join(stats, group, "left")

        def stat(name):
            return F.col(name)
    else:
        # one global row: a single scalar subquery carrying all statistics
        packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
        joined = df

        def stat(name):
            return packed.getField(name)
    out = joined.withColumns({
        f"{c}{suffix}": (F.col(c) - stat(f"{c}_mean")) /
        F.when(stat(f"{c}_std") == 0, F.lit(1.0)).otherwise(stat(f"{c}_std"))
        for c in cols})
    if group:
        out = out.drop(*[f"{c}_mean" for c in cols], *[f"{c}_std" for c in cols])
    return out


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """M3 as a model object (one row of 2 x 8 numbers reaches the driver)."""
    row = scaling_stats(df, cols).first()
    return Scaler({c: row[f"{c}_mean"] for c in cols},
                  {c: (row[f"{c}_std"] or 0.0) for c in cols})


@dataclass
class Ensemble:
    """M4/M5 fitted models + M6 importances."""
    rf: object
    gb: object
    cols: list[str]
    importances: dict[str, float] = field(default_factory=dict)
    rf_r2: float | None = None
    gb_r2: float | None = None


def _assembler(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")


def train_ensemble(train: DataFrame, cols: list[str], label: str = LABEL,
                   test: DataFrame | None = None) -> Ensemble:
    """M4 random forest (100 trees, depth 10) + M5 boosted trees (100 x depth 6).

    Spark bins features (``maxBins``) and boosts first-order, so values are
    close to but not equal to the reference libraries'.
    """
    asm = _assembler(cols)
    data = asm.transform(train).select("features", F.col(label).alias("label"))
    rf = RandomForestRegressor(labelCol="label", **RF_PARAMS, **TRAIN_EXEC).fit(data)
    gb = GBTRegressor(labelCol="label", **GB_PARAMS, **TRAIN_EXEC).fit(data)
    names = [FEATURES.get(c.removesuffix("_z"), c) for c in cols]
    imp = dict(zip(names, [float(x) for x in rf.featureImportances.toArray()]))
    ens = Ensemble(rf, gb, cols, imp)
    if test is not None:
        scored = predict(ens, test, label)
        r = scored.select(r2(F.col(label), F.col("rf_pred")).alias("rf"),
                          r2(F.col(label), F.col("gb_pred")).alias("gb")).first()
        ens.rf_r2, ens.gb_r2 = r["rf"], r["gb"]
    return ens


def predict(ens: Ensemble, df: DataFrame, label: str | None = None) -> DataFrame:
    """M9 per-row forest, boosted and ensemble predictions + agreement."""
    v = _assembler(ens.cols).transform(df)
    v = ens.rf.setPredictionCol("rf_pred").transform(v)
    v = ens.gb.setPredictionCol("gb_pred").transform(v)
    return ensemble_columns(v.drop("features"), F.col("rf_pred"), F.col("gb_pred"))


def ensemble_columns(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """M9/M10 weighted ensemble, pairwise agreement and the +-|a-b| band."""
    wa, wb = ENSEMBLE_WEIGHTS
    ens = a * wa + b * wb
    spread = F.abs(a - b)
    return df.withColumns({
        "ensemble_pred": ens,
        "agreement": 1 - spread / (F.abs(a) + F.abs(b) + 1),
        "band_lower": ens - spread,
        "band_upper": ens + spread,
    })


def r2(y: Column, p: Column) -> Column:
    """M7 coefficient of determination as one aggregate expression."""
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return 1 - F.try_divide(ss_res, ss_tot)


def importances_frame(spark: SparkSession, ens: Ensemble, top: int | None = None) -> DataFrame:
    """M6 (feature, importance) rows; O5 ``top`` keeps the highest ones."""
    df = spark.createDataFrame(sorted(ens.importances.items()), "feature string, importance double")
    if top:
        df = df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
    return df


def what_if(last_rows: DataFrame, factor: float = 1.1, recompute_derived: bool = True) -> DataFrame:
    """M8 next-shift scenario: last row with units and defects x factor.

    The derived ratios are recomputed from the scaled values (the reference
    leaves them stale); rolling means stay as observed.
    """
    out = last_rows.withColumns({
        "units_produced": F.col("units_produced") * factor,
        "defective_units": F.col("defective_units") * factor})
    if recompute_derived:
        out = derived_features(out)
    return out


def anomaly_timeline(flags: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """M12 (row index, downtime, is_anomaly) per series."""
    return windows.row_index(flags, series, order).select(
        *series, "row_index", "downtime_min", "is_anomaly")


def insight_record(prediction: Column, confidence: Column, anomalies: Column,
                   importances: Column, defect_rate: Column) -> Column:
    """M13 the insight record (struct) from model outputs."""
    return F.struct(
        prediction.alias("prediction"), confidence.alias("confidence"),
        anomalies.cast("int").alias("anomalies_detected"),
        importances.alias("feature_importance"),
        N.risk_level(prediction).alias("risk_level"),
        N.ml_recommendations(prediction, anomalies, defect_rate).alias("recommendations"))
