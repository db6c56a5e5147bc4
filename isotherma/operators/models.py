"""Residual-correction models on Spark ML.

Models learn ``delta = obs - model``; a prediction is the model value plus the learned delta. Folds, features,
recipes and trials are short driver-side lists; every fit and every prediction is a Spark job over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import confidence
from ..functions.numbers import finite
from ..session import cut_lineage
from .diagnostics import columns_long
from .metrics import error_metrics
from .ordered import exact_quantiles, row_positions

LABEL = "_delta"
PRIOR_WEIGHT = 0.05
GATE_TEMPERATURE = 0.5
# Blend weight and regime count that won per target.
BLEND = {"tchp": (0.75, 6), "d26": (0.5, 12)}


# -- estimators -----------------------------------------------------------------------------------------------------

def prepare(features: Sequence[str], scale: bool = True) -> list[Estimator]:
    """M1: median imputation and scaling, fitted on the training rows only."""
    filled = [f"_i_{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=1e-4),
              VectorAssembler(inputCols=filled, outputCol="_raw_features" if scale else "features")]
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_raw_features", outputCol="features"))
    return stages


def prepared(df: DataFrame, training: Column, features: Sequence[str]) -> DataFrame:
    """M1 with exact medians: ``z_<feature>``, imputed and scaled by the training rows. What comes to the driver is one row of each.

    A feature without spread in the training rows is 0; without any value in them, NULL stays NULL.
    """
    rows = df.select("*", *[finite(f).alias(f"_x_{f}") for f in features])
    train = rows.where(training)
    long = columns_long(train, [f"_x_{f}" for f in features]).where("value IS NOT NULL")
    found = exact_quantiles(long, ["column_name"], "value", [0.5]).collect()  # a row per feature
    medians = {r["column_name"]: r["quantile"] for r in found}
    filled = {f: F.coalesce(f"_x_{f}", F.lit(medians.get(f"_x_{f}")).cast("double")) for f in features}
    stats = train.agg(*[c for f, x in filled.items() for c in (F.avg(x).alias(f"m_{f}"), F.stddev_samp(x).alias(f"s_{f}"))]).first()
    scaled = [(F.when(x.isNotNull(), F.lit(0.0)) if not stats[f"s_{f}"] else (x - stats[f"m_{f}"]) / stats[f"s_{f}"]).alias(f"z_{f}") for f, x in filled.items()]
    return rows.select(*df.columns, *scaled)


def ridge_delta(train: DataFrame, obs: str, base: str, alpha: float = 1.0) -> Estimator:
    """M2: the penalty alpha on summed squares is alpha / rows on their mean. Spark ML divides it by the label's deviation, so it is given times that."""
    delta = F.col(obs) - F.col(base)
    rows, spread = train.agg(F.count(delta), F.stddev_pop(delta)).first()
    return LinearRegression(labelCol=LABEL, elasticNetParam=0.0, regParam=alpha / max(rows, 1) * (spread or 1.0), standardization=False, solver="normal")


def forest_delta(trees: int = 300, min_leaf: int = 2, subset: str = "all", depth: int = 30, seed: int = 42) -> Estimator:
    """M3. Spark's trees stop at depth 30, which a table of some billion rows does not reach before its leaves are small."""
    return RandomForestRegressor(labelCol=LABEL, numTrees=trees, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset,
                                 maxDepth=depth, seed=seed, maxMemoryInMB=1024, maxBins=256)


def boosted_delta(trees: int = 300, depth: int = 4, rate: float = 0.03, subsample: float = 0.8, columns: str = "0.8",
                  seed: int = 42, weight: str | None = None) -> Estimator:
    """M4"""
    gbt = GBTRegressor(labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                       featureSubsetStrategy=columns, seed=seed)
    return gbt.setWeightCol(weight) if weight else gbt


# -- fitting and out-of-fold prediction -----------------------------------------------------------------------------

def training_rows(df: DataFrame, features: Sequence[str], obs: str, base: str) -> DataFrame:
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull())
    return rows.select("*", *[F.col(f).cast("double").alias(f"_f_{f}") for f in features], (F.col(obs) - F.col(base)).alias(LABEL))


def fit_delta(train: DataFrame, features: Sequence[str], estimator: Estimator, obs: str, base: str, scale: bool = False) -> PipelineModel:
    names = [f"_f_{f}" for f in features]
    return Pipeline(stages=[*prepare(names, scale), estimator]).fit(training_rows(train, features, obs, base))


def predict_delta(model: PipelineModel, df: DataFrame, features: Sequence[str], base: str, out: str = "pred") -> DataFrame:
    rows = df.select("*", *[F.col(f).cast("double").alias(f"_f_{f}") for f in features])
    scored = model.transform(rows)
    return scored.select(*df.columns, (F.col(base) + F.col("prediction")).alias(out))


def raw_baseline(df: DataFrame, model: str, out: str = "pred") -> DataFrame:
    """M0: the model value itself."""
    return df.withColumn(out, F.col(model))


def mean_delta(train: DataFrame, df: DataFrame, obs: str, model: str, out: str = "pred") -> DataFrame:
    """M0: the model value plus the mean training delta."""
    return df.withColumn(out, F.col(model) + train.agg(F.avg(F.col(obs) - F.col(model))).scalar())


def fold_sides(df: DataFrame, roles: DataFrame, key: str, fold: int) -> tuple[DataFrame, DataFrame]:
    mine = roles.where(F.col("fold") == fold)
    side = lambda r: df.join(mine.where(F.col("role") == r).select(key), key, "left_semi")
    return side("train"), side("validation")


def fold_ids(roles: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in roles.select("fold").distinct().collect())


Fit = Callable[[DataFrame], Estimator]


def oof_predict(df: DataFrame, roles: DataFrame, key: str, features: Sequence[str], estimator: Estimator | Fit, *, obs: str,
                base: str, scale: bool = False, out: str = "pred") -> DataFrame:
    """M6: predictions of each validation fold by a model fitted on its training fold only.

    ``estimator`` is any Spark ML estimator with label column ``_delta``, or a function from the training rows to one.
    """
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull())
    parts = []
    for fold in fold_ids(roles):
        train, val = fold_sides(rows, roles, key, fold)
        chosen = estimator if isinstance(estimator, Estimator) else estimator(train)
        model = fit_delta(train, features, chosen, obs, base, scale)
        parts.append(predict_delta(model, val, features, base, out).withColumn("fold", F.lit(fold)))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def ensemble_mean(df: DataFrame, columns: Sequence[str], out: str = "ensemble") -> DataFrame:
    """M5"""
    return df.withColumn(out, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


# -- searches -------------------------------------------------------------------------------------------------------

def _mae(oof: DataFrame, obs: str) -> float:
    return float(oof.agg(F.avg(F.abs(F.col("pred") - F.col(obs)))).first()[0])


def grid_sweep(train: DataFrame, test: DataFrame, date: str, feature_sets: dict[str, Sequence[str]], inner: Sequence[int],
               settings: Sequence[dict], *, obs: str, base: str) -> DataFrame:
    """Settings ranked by inner-fold MAE of the training side; the test MAE is reported, never ranked."""
    from .splits import inner_folds

    results = []
    for name, features in feature_sets.items():
        for k in inner:
            roles = cut_lineage(inner_folds(train, date, k))
            for i, setting in enumerate(settings):
                cv = _mae(oof_predict(train, roles, date, features, boosted_delta(**setting), obs=obs, base=base), obs)
                model = fit_delta(train, features, boosted_delta(**setting), obs, base)
                rows = test.where(F.col(obs).isNotNull() & F.col(base).isNotNull())
                score = _mae(predict_delta(model, rows, features, base), obs)
                results.append((name, k, i, str(setting), cv, score))
    out = train.sparkSession.createDataFrame(results, "feature_set string, inner_folds int, setting int, params string, cv_mae double, test_mae double")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cv_mae", "feature_set", "inner_folds", "setting")))


def recipe_ablation(df: DataFrame, roles: DataFrame, key: str, sets: dict[str, Sequence[str]], estimator: Estimator | Fit, *,
                    obs: str, base: str, split: str = "forward", target: str = "tchp", optional: Sequence[str] = ()) -> DataFrame:
    """M8, M9: out-of-fold metrics per feature set; sets that only lack optional columns are skipped."""
    from .filters import require_columns

    parts = []
    for name, columns in sets.items():
        columns = require_columns(df, columns, optional)
        if columns is None:
            continue
        oof = oof_predict(df, roles, key, columns, estimator, obs=obs, base=base)
        m = error_metrics(oof, obs, "pred", None).select(F.lit(target).alias("target"), F.lit(split).alias("split"), F.lit(name).alias("feature_set"), "*")
        parts.append(m)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def backward_elimination(df: DataFrame, roles: DataFrame, key: str, features: Sequence[str], estimator: Estimator | Fit, *,
                         obs: str, base: str, keep: int = 4) -> DataFrame:
    """Repeatedly drop the feature whose removal gives the lowest out-of-fold MAE."""
    current, trail = list(features), []
    trail.append((0, "", len(current), _mae(oof_predict(df, roles, key, current, estimator, obs=obs, base=base), obs)))
    while len(current) > keep:
        trials = {f: _mae(oof_predict(df, roles, key, [c for c in current if c != f], estimator, obs=obs, base=base), obs) for f in current}
        worst = min(trials, key=lambda f: (trials[f], f))
        current.remove(worst)
        trail.append((len(trail), worst, len(current), trials[worst]))
    return df.sparkSession.createDataFrame(trail, "step int, removed string, n_features int, mae double")


def _multiplier(n: int) -> int:
    for a in (104729, 7919, 611953, 15485863):
        if math.gcd(a, n) == 1:
            return a
    return 1


def permutation_importance(model: PipelineModel | Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], id_col: str, *,
                           obs: str, base: str, repeats: int = 5) -> DataFrame:
    """Rise of the MAE when one column is moved between rows.

    Rows are numbered by id; row p takes the value of row (p·a + r) mod n, a one-to-one move. All features and repeats are moved by
    one join and scored in one pass. ``model`` is a fitted pipeline, or a function that adds ``pred`` from the features and the base value ``_base``.
    """
    predicted = model if callable(model) else lambda d: predict_delta(model, d, features, "_base")
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull())
    placed = cut_lineage(row_positions(rows, id_col, "_pos"))
    n = placed.count()
    a = _multiplier(n)
    mae = F.avg(F.abs(F.col("pred") - F.col(obs)))
    baseline = predicted(placed.withColumn("_base", F.col(base))).agg(mae.alias("base_mae"))
    # All copies are scored in one pass: a row per repeat, joined with the row it takes its values from, then a row per feature moved.
    number = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat")
    target = (F.col("_pos") * F.lit(a).cast("long") + 1 + F.col("repeat") * 31) % n
    moved = placed.select("*", number).withColumn("_to", target).join(placed.select(F.col("_pos").alias("_to"), *[F.col(f).alias(f"_m_{f}") for f in features]), "_to")
    moved = moved.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    # The base value of a row stays its own, also while it is moved as a feature.
    swapped = moved.select("feature", "repeat", obs, F.col(base).alias("_base"), *[
        F.when(F.col("feature") == c, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in features if c != obs])
    scores = predicted(swapped).groupBy("feature", "repeat").agg(mae.alias("mae"))
    asked = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"), number)
    out = asked.join(scores, ["feature", "repeat"], "left")
    out = out.withColumn("_base", baseline.scalar())
    gain = F.col("mae") - F.col("_base")
    return out.groupBy("feature").agg(F.avg(gain).alias("importance"), F.coalesce(F.stddev_pop(gain), F.lit(0.0)).alias("spread"))


def gain_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Split-gain importance of a tree model."""
    scores = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(s)) for f, s in zip(features, scores)], "feature string, gain double").orderBy(F.desc("gain"), "feature")


# -- mixtures -------------------------------------------------------------------------------------------------------

def blend(df: DataFrame, geo: str, regime: str, alpha: float, out: str = "pred_blend") -> DataFrame:
    """M14"""
    return df.withColumn(out, alpha * F.col(geo) + (1.0 - alpha) * F.col(regime))


def best_prior_per_region(scores: DataFrame, region="region", prior="prior", mae="mae") -> DataFrame:
    """The prior with the lowest MAE per region. Chosen on the scores it is reported on: selection-biased."""
    return scores.groupBy(region).agg(F.min_by(prior, F.struct(mae, prior)).alias("best_prior"), F.min(mae).alias("best_mae")).withColumn(
        "selection_biased", F.lit(1))


# -- bundles, scoring, layers ---------------------------------------------------------------------------------------

def freeze_bundle(model: PipelineModel, train: DataFrame, path: str, *, features: Sequence[str], obs: str, platform="platform",
                  event="event", date="obs_date", extra: dict[str, str] | None = None) -> None:
    """Save the pipeline and one row of metadata next to it."""
    model.write().overwrite().save(f"{path}/model")
    meta = train.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(platform).alias("platforms"),
                     F.sort_array(F.collect_set(event)).alias("events"), F.min(date).cast("string").alias("first_date"),
                     F.max(date).cast("string").alias("last_date"))
    for k, v in {"target": obs, "features": ",".join(features), **(extra or {})}.items():
        meta = meta.withColumn(k, F.lit(v))
    meta.write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")


def support_list(queries: DataFrame, support: DataFrame, *, query_id="query_id", obs_id="obs_id", time="ts", radius_km: float = 200.0, window_h: float = 72.0,
                 limit: int = 10, carry: Sequence[str] = ()) -> DataFrame:
    """The supporting observations of each query, nearest first, then those with the smallest time gap: rank, distance and gap, and what
    is carried along of the observation."""
    from .spatial import support_join

    near = support_join(queries.select(query_id, "lat", "lon", time), support, query_cols=[query_id], obs_cols=[obs_id, *carry], time=time,
                        radius_km=radius_km, window_h=window_h, limit=limit, tie=[obs_id])
    return near.select(query_id, "rank", obs_id, *carry, F.col("p_lat").alias("obs_lat"), F.col("p_lon").alias("obs_lon"), "distance_km", F.col("gap_h").alias("time_delta_h"))


def cell_corrections(grid: DataFrame, model: PipelineModel, features: Sequence[str], base="tchp", out="correction") -> DataFrame:
    """The learned correction of every cell; NULL where the grid has no value to correct."""
    return predict_delta(model, grid, features, base, "_best").withColumn(out, F.col("_best") - F.col(base)).drop("_best")


def score(queries: DataFrame, grid: DataFrame, support: DataFrame, model: PipelineModel | None, features: Sequence[str], *,
          query_id="query_id", time="ts", date="dt", radius_km: float = 200.0, window_h: float = 72.0, limit: int = 10,
          metric: str = "planar_deg", enrich: Callable[[DataFrame], DataFrame] = lambda d: d, source: str = "ml_correction") -> DataFrame:
    """Best heat-content estimate for a table of points and times.

    Nearest valid cell of the day, its value, the learned correction and where it is from, the number of supporting observations (their list is
    ``support_list``) and a confidence.
    """
    from .spatial import nearest_cell

    cells = nearest_cell(queries, grid, obs_cols=[query_id, date], metric=metric)
    rows = cells.join(grid.select(date, "y", "x", F.col("tchp").alias("model_tchp"), "sst_c").hint("merge"), [date, "y", "x"])
    rows = enrich(rows.join(queries.select(query_id, "lat", "lon", time), query_id))
    if model is not None:
        rows = predict_delta(model, rows, features, "model_tchp", "corrected_tchp")
    else:
        rows = rows.withColumn("corrected_tchp", F.lit(None).cast("double"))
    near = support_list(queries, support, query_id=query_id, time=time, radius_km=radius_km, window_h=window_h, limit=limit)
    counts = near.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_support"), F.min("distance_km").alias("nearest_support_km"))
    out = rows.join(counts, query_id, "left").withColumn("n_support", F.coalesce("n_support", F.lit(0)))
    best = F.coalesce("corrected_tchp", "model_tchp")
    return out.select(query_id, date, "y", "x", F.col("distance_km").alias("grid_distance_km"), "model_tchp", "corrected_tchp",
                      (F.col("corrected_tchp") - F.col("model_tchp")).alias("correction_delta"),
                      F.when(F.col("corrected_tchp").isNotNull(), source).otherwise("raw").alias("correction_source"), best.alias("best_tchp"), "n_support", "nearest_support_km",
                      confidence("n_support", F.lit("tchp" in grid.columns)).alias("confidence"))


LAYER_KINDS = ("tchp", "d26", "correction", "corrected", "observations")


def corrected_layer(kind: str, grid: DataFrame, *, stride: int, surface="sst_c", correction: str | None = None,
                    observations: DataFrame | None = None, box: Column | None = None, limit: int | None = None) -> DataFrame:
    """Points of one map layer; ``corrected`` falls back to the raw value where no correction is known.

    ``limit`` is the number of points with a value per date, in row-major order.
    """
    from .filters import stride_thin, top_per_group

    if kind not in LAYER_KINDS:
        raise ValueError(f"unknown layer {kind!r}")
    if kind == "observations":
        return observations.select("dt", F.lit(kind).alias("layer"), "lat", "lon", F.col("obs_value").alias("value"))
    known = F.col(correction) if correction else F.lit(None).cast("double")
    value = {"tchp": F.col("tchp"), "d26": F.col("d26"), "correction": known,
             "corrected": F.coalesce(F.col("tchp") + known, "tchp")}[kind]
    known_points = stride_thin(grid, stride, surface, box).withColumn("value", value).where(F.col("value").isNotNull())
    if limit is not None:
        known_points = top_per_group(known_points, ["dt"], limit, F.col("y"), F.col("x"))
    return known_points.select("dt", F.lit(kind).alias("layer"), "lat", "lon", "value")


def benchmark_report(metrics: DataFrame, raw_name: str, by: Sequence[str] = ("holdout",)) -> DataFrame:
    """Best model against the raw value, per holdout."""
    rows = metrics.groupBy(*by).agg(
        F.max(F.when(F.col("model") == raw_name, F.col("mae"))).alias("raw_mae"),
        F.min(F.when(F.col("model") != raw_name, F.struct("mae", "model"))).alias("_b"))
    return rows.select(*by, "raw_mae", F.col("_b.model").alias("best_model"), F.col("_b.mae").alias("best_mae"),
                       (F.col("raw_mae") - F.col("_b.mae")).alias("improvement"),
                       (100.0 * (F.col("raw_mae") - F.col("_b.mae")) / F.col("raw_mae")).alias("improvement_pct"))
