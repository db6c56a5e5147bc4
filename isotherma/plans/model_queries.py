"""Models (M), scoring and map layers, incremental append (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import boosting, experts, filters, metrics, models, recipes, ridge, splits
from ..session import cut_lineage, shared_folder, stored
from ..sources import writers
from .join_queries import seconds
from .metric_queries import PAIRS
from .registry import hav, query, ridge_sql
from .scalar_queries import EXPERT, SEASON

FEATURES = ["lat", "lon", "model_tchp", "model_d26", "ssh_m", "mlt_m", "sst_c"]
OBS, BASE = "obs_tchp", "model_tchp"
PRIOR = models.PRIOR_WEIGHT
REGIMES = ["model_tchp", "model_d26", "sst_c", "ssh_m", "mlt_m", "lat"]


def table(v):
    rows = v.casts.where("obs_tchp IS NOT NULL AND model_tchp IS NOT NULL")
    return rows.withColumn("abs_lat", F.abs("lat"))


# Boosted models are fitted once per session and table.
_FITTED: dict = {}


def fitted(v, name, make):
    at = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if at not in _FITTED:
        _FITTED[at] = make()
    return _FITTED[at]


def forward_models(v):
    """Boosters of the forward folds, and the rows with their roles."""
    def make():
        rows = table(v).withColumn(models.LABEL, F.col(OBS) - F.col(BASE))
        roles = splits.forward_folds(rows, "obs_date")
        folds = models.fold_ids(roles)
        rows = experts.with_roles(rows, roles, "obs_date", folds)  # not stored: it outlives the query
        return experts.fold_plan(folds, FEATURES).fit(rows, models.LABEL, ["cast_id"]), rows, folds
    return fitted(v, "forward", make)


OUTER = "year <= 1998"


def later_rows(v):
    """Rows with their label and region."""
    return table(v).withColumn(models.LABEL, F.col(OBS) - F.col(BASE)).withColumn(experts.REGION, fn.expert_region("lat", "lon"))


def regions(v):
    return fitted(v, "region names", lambda: sorted(r[0] for r in later_rows(v).select(experts.REGION).distinct().collect()))  # at most five


def regimes(v):
    """Regimes of the outer side."""
    return fitted(v, "regime centres", lambda: experts.find_regimes("outer", later_rows(v).where(OUTER), REGIMES, models.BLEND["tchp"][1]))


def later_models(v, kind):
    """Boosters for the later years: of the outer side (whole), of all rows (all), or the outer side's experts by region or regime at the usual prior.

    A query fits those it asks for. Bins are cut over all rows, so a booster is the same whichever others are fitted with it.
    """
    def make():
        rows, train = later_rows(v), F.expr(OUTER)
        if kind == "regimes":
            rows, plan = regimes(v).labelled(rows), experts.regime_plan(regimes(v), train, FEATURES)
        elif kind == "regions":
            plan = experts.region_plan("outer", train, regions(v), [PRIOR], FEATURES)
        else:
            plan = experts.single(kind, train if kind == "whole" else F.lit(True), FEATURES)
        return plan.fit(rows, models.LABEL, ["cast_id"], F.lit(True))
    return fitted(v, f"boosters: {kind}", make)


TEST = "year >= 1999"


def penalty(base):
    """The penalty follows the rows of each fit."""
    return lambda train: models.ridge_delta(train, OBS, base)


def forward(v, df):
    return cut_lineage(splits.forward_folds(df, "obs_date"))


def long_metrics(df, columns, by=()):
    long = metrics.predictions_long(df, [OBS, *by], columns)
    return metrics.error_metrics(long, OBS, "pred", None, ["model", *by]).select("model", *by, "rows", "mae", "bias")


@query("m00_raw_baseline", f"SELECT cast_id, p AS pred FROM {PAIRS} t", "pred")
def _(v):
    return models.raw_baseline(table(v), BASE).select("cast_id", "pred")


@query("m00_mean_delta", f"SELECT cast_id, p + (SELECT avg(o - p) FROM {PAIRS} t WHERE year <= 1998) AS pred FROM {PAIRS} t WHERE year >= 1999", "pred")
def _(v):
    rows = table(v)
    return models.mean_delta(rows.where("year <= 1998"), rows.where("year >= 1999"), OBS, BASE).select("cast_id", "pred")


TRAIN = "year <= 1998"


@query("m01_prepare", f"WITH tr AS (SELECT * FROM fx_casts WHERE {TRAIN}), m AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS q_{f}" for f in FEATURES) + " FROM tr), s AS (SELECT " + ", ".join(
    f"avg(coalesce({f}, q_{f})) AS m_{f}, stddev_samp(coalesce({f}, q_{f})) AS s_{f}" for f in FEATURES) + " FROM tr, m) SELECT cast_id, " + ", ".join(
    f"(coalesce({f}, q_{f}) - m_{f})/s_{f} AS z_{f}" for f in FEATURES) + " FROM fx_casts, m, s", " ".join(f"z_{f}" for f in FEATURES))
def _(v):
    return models.prepared(v.casts, F.expr(TRAIN), FEATURES).select("cast_id", *[f"z_{f}" for f in FEATURES])


# Ridge on one feature has a closed form: slope = cov / (var + alpha / n). Monthly means, as the solver's last digits differ.
@query("m02_ridge_delta", f"""WITH tr AS (SELECT mlt_m AS x, o - p AS y FROM {PAIRS} t WHERE year <= 1998), s AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx, count(*) AS n FROM tr)
  SELECT month, count(*) AS rows, avg(p + my + cxy/(vx + 1.0/n)*(mlt_m - mx)) AS pred FROM {PAIRS} t, s WHERE year >= 1999 GROUP BY month""", "pred", digits=4)
def _(v):
    rows = table(v)
    train = rows.where("year <= 1998")
    model = models.fit_delta(train, ["mlt_m"], models.ridge_delta(train, OBS, BASE), OBS, BASE)
    scored = models.predict_delta(model, rows.where("year >= 1999"), ["mlt_m"], BASE)
    return scored.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.avg("pred").alias("pred"))


@query("m04_boosted_delta")
def _(v):
    model, rows = later_models(v, "whole"), later_rows(v)
    scored = boosting.predict(model, rows.where(TEST), {"delta": ("whole", None)})
    return scored.select("cast_id", (F.col(BASE) + F.col("delta")).alias("pred"))


STUMP = """SELECT f, t, gl, hl, gr, hr FROM (SELECT f, x AS t, sum(sum(y)) OVER o AS gl, sum(count(*)) OVER o AS hl, sum(sum(y)) OVER (PARTITION BY f) - sum(sum(y)) OVER o AS gr,
    sum(count(*)) OVER (PARTITION BY f) - sum(count(*)) OVER o AS hr FROM (SELECT 'mlt_m' AS f, mlt_m AS x, {y} AS y FROM {rows} UNION ALL SELECT 'ssh_m', ssh_m, {y} FROM {rows}) GROUP BY f, x
    WINDOW o AS (PARTITION BY f ORDER BY x)) WHERE hr > 0 ORDER BY gl*gl/(hl + 1.0) + gr*gr/(hr + 1.0) DESC, f, t LIMIT 1"""
LEAF = "CASE WHEN CASE {s}.f WHEN 'mlt_m' THEN mlt_m ELSE ssh_m END <= {s}.t THEN 0.3*{s}.gl/({s}.hl + 1.0) ELSE 0.3*{s}.gr/({s}.hr + 1.0) END"


# Two trees of one split each, so that SQL can say what they are.
@query("m04_boosted_stumps", f"""WITH tr AS (SELECT *, o - p AS d FROM {PAIRS} t WHERE year <= 1998), m AS (SELECT avg(d) AS mu FROM tr), r1 AS (SELECT tr.*, d - mu AS y1 FROM tr, m),
  s1 AS ({STUMP.format(y="y1", rows="r1")}), r2 AS (SELECT r1.*, y1 - {LEAF.format(s="s1")} AS y2 FROM r1, s1), s2 AS ({STUMP.format(y="y2", rows="r2")})
  SELECT cast_id, p + mu + {LEAF.format(s="s1")} AS pred_1, p + mu + {LEAF.format(s="s1")} + {LEAF.format(s="s2")} AS pred_2 FROM {PAIRS} t, m, s1, s2 WHERE year >= 1999""", "pred_1 pred_2")
def _(v):
    rows = table(v).withColumn(models.LABEL, F.col(OBS) - F.col(BASE))
    plan = experts.single("stumps", F.col("year") <= 1998, ["mlt_m", "ssh_m"], trees=2, depth=1, rate=0.3, subsample=1.0, columns=1.0)
    scored = boosting.predict(plan.fit(rows, models.LABEL, ["cast_id"]), rows.where(TEST), {"d1": ("stumps", 1), "d2": ("stumps", None)})
    return scored.select("cast_id", (F.col(BASE) + F.col("d1")).alias("pred_1"), (F.col(BASE) + F.col("d2")).alias("pred_2"))


TWO_SETS = {"mlt_ssh": ["mlt_m", "ssh_m"], "sst_model": ["sst_c", "model_tchp"]}


@query("m05_ensemble_mean", f"""WITH tr AS (SELECT *, o - p AS d FROM {PAIRS} t WHERE {TRAIN}), s AS (SELECT {ridge_sql("mlt_m", "d", "ssh_m", 1)}, {ridge_sql("sst_c", "d", "p", 2)} FROM tr)
  SELECT cast_id, p + (my1 + bx1*(mlt_m - mx1) + bz1*(ssh_m - mz1) + my2 + bx2*(sst_c - mx2) + bz2*(p - mz2))/2 AS ensemble FROM {PAIRS} t, s WHERE year >= 1999""", "ensemble")
def _(v):
    """The mean of two fitted models."""
    rows = table(v).withColumn("_delta", F.col(OBS) - F.col(BASE)).withColumns({"_train": F.expr(TRAIN), "_val": F.col("year") >= 1999})
    m = ridge.moments(rows, FEATURES, "_delta", ["_train"])
    long = ridge.predictions(rows, m, TWO_SETS, ["_val"], BASE, keep=["cast_id"])
    wide = long.groupBy("cast_id").agg(*[F.max(F.when(F.col("feature_set") == n, F.col("pred"))).alias(n) for n in TWO_SETS])
    return models.ensemble_mean(wide, list(TWO_SETS)).select("cast_id", "ensemble")


@query("m06_oof_predict")
def _(v):
    model, rows, folds = forward_models(v)
    return experts.out_of_fold(model, rows, folds, BASE).select("cast_id", "fold", "pred")


def recipe_rows(v):
    """Casts with every column that the named recipes use: their own, those of their levels, and those of the grid's band of the day."""
    deep = v.levels.groupBy("cast_id").agg(
        F.avg("sigma0").alias("model_steric_1000_ref2000_m"), F.max("sigma0").alias("model_n2_max_upper200_s2"), F.stddev_pop("sigma0").alias("model_n2_mean_to_d26_s2"),
        F.avg("rho").alias("model_steric_0_1000_m"), F.max("depth_m").alias("model_ild_m"), F.min("depth_m").alias("model_blt_dt02_m"),
        F.max("rho").alias("model_n2_max_near_mld_s2"), F.min("rho").alias("model_n2_max_above_mld_s2"), F.avg("depth_m").alias("model_barrier_layer_thickness_m"))
    band = F.floor(F.col("lat") / 10)
    near = v.grid.groupBy("dt", band.alias("band")).agg(*[e for f, s in (("tchp", "tchp"), ("d26", "d26"), ("sst_c", "sst")) for e in (
        F.stddev_pop(f).alias(f"model_{s}_local_std_1deg"), (F.max(f) - F.min(f)).alias(f"model_{s}_grad_mag_per_100km"), F.avg(f).alias(f"model_{s}_anom_from_1deg_mean"))],
        (F.max("tchp") - F.avg("tchp")).alias("model_tchp_local_std_2deg"))
    own = {
        "model_interp_tchp_kj_per_cm2": "model_tchp", "model_interp_d26_m": "model_d26", "month_int": "month", "month_sin": "sin(2*pi()*month/12)", "month_cos": "cos(2*pi()*month/12)",
        "doy_sin": "sin(2*pi()*dayofyear(obs_date)/365.25)", "doy_cos": "cos(2*pi()*dayofyear(obs_date)/365.25)", "is_winter_jfm": "int(month <= 3)", "is_summer_jas": "int(month BETWEEN 7 AND 9)",
        "is_other": "int(month NOT IN (1, 2, 3, 7, 8, 9))", "abs_lat": "abs(lat)", "nearest_rtofs_grid_distance_km": "(cast_id % 97)/10.0", "model_ssh_m": "ssh_m",
        "model_mixed_layer_thickness_m": "mlt_m", "model_surface_boundary_layer_thickness_m": "sblt_m", "model_temp_excess_26c": "sst_c - 26", "model_surface_temp_c": "sst_c",
        "model_ssh_x_abs_lat": "ssh_m*abs(lat)", "model_mlt_x_abs_lat": "mlt_m*abs(lat)", "model_temp_excess_x_abs_lat": "(sst_c - 26)*abs(lat)",
        "d26_minus_mlt_m": "model_d26 - mlt_m", "d26_to_sblt_ratio": "model_d26/nullif(sblt_m, 0)"}
    rows = v.casts.withColumns({n: F.expr(e) for n, e in own.items()}).withColumn("band", band)
    return rows.join(deep, "cast_id", "left").join(near, ["dt", "band"], "left")


def with_forward(v, rows):
    """Rows with their roles in the forward folds, and the folds; stored, as fits and their steps read the rows many times."""
    roles = forward(v, rows)
    folds = models.fold_ids(roles)
    return stored(experts.with_roles(rows, roles, "obs_date", folds), "forward-rows"), folds


@query("m08_recipe_ablation")
def _(v):
    """The eleven recipes of each target."""
    rows, folds = with_forward(v, stored(recipe_rows(v), "recipe-rows"))
    parts = [ridge.ablation(rows, folds, recipes.recipes(t), obs=f"obs_{t}", base=f"model_{t}", target=t) for t in ("tchp", "d26")]
    return parts[0].unionByName(parts[1])


@query("m09_geography_ladder")
def _(v):
    """The four nested sets over forward, tile and platform folds."""
    rows = stored(recipe_rows(v).withColumn("tile", fn.tile15("lat", "lon")), "ladder-rows")
    sets = recipes.geography_ladder(recipes.STATE)
    parts = []
    for split, key in (("forward", "obs_date"), ("tile", "tile"), ("platform", "platform")):
        usable = rows.where("obs_tchp IS NOT NULL AND model_tchp IS NOT NULL")
        roles = forward(v, usable) if split == "forward" else cut_lineage(splits.group_roles(usable, key))
        folds = models.fold_ids(roles)
        parts.append(ridge.ablation(experts.with_roles(usable, roles, key, folds), folds, sets, obs=OBS, base=BASE, split=split))
    return metrics.ablation_increments(parts[0].unionByName(parts[1]).unionByName(parts[2]), list(sets))


@query("m10_backward_elimination")
def _(v):
    """The largest recipe down to four features."""
    rows, folds = with_forward(v, stored(recipe_rows(v), "elimination-rows"))
    whole = max(recipes.recipes("tchp").values(), key=len)
    return ridge.elimination(rows, folds, whole, obs=OBS, base=BASE)


# Two sets of two features each, solved from the same moments.
@query("m08_two_feature_sets", f"""WITH tr AS (SELECT *, o - p AS d FROM {PAIRS} t WHERE year <= 1997), s AS (SELECT {ridge_sql("mlt_m", "d", "ssh_m", 1)}, {ridge_sql("sst_c", "d", "p", 2)} FROM tr),
  r AS (SELECT 'mlt_ssh' AS feature_set, p + my1 + bx1*(mlt_m - mx1) + bz1*(ssh_m - mz1) - o AS e FROM {PAIRS} t, s WHERE year >= 1998
    UNION ALL SELECT 'sst_model', p + my2 + bx2*(sst_c - mx2) + bz2*(p - mz2) - o FROM {PAIRS} t, s WHERE year >= 1998)
  SELECT feature_set, count(*) AS rows, avg(abs(e)) AS mae, avg(e) AS bias FROM r GROUP BY feature_set""", "mae bias")
def _(v):
    rows = table(v).withColumn("role_1", F.when(F.col("year") <= 1997, "train").otherwise("validation"))
    return ridge.ablation(rows, [1], TWO_SETS, obs=OBS, base=BASE).select("feature_set", "rows", "mae", "bias")


@query("m11_permutation_importance")
def _(v):
    model, rows = later_models(v, "all"), later_rows(v)
    predict = lambda df: boosting.predict(model, df, {"_delta_hat": ("all", None)}).withColumn("pred", F.col("_base") + F.col("_delta_hat")).drop("_delta_hat")
    return models.permutation_importance(predict, rows.select("cast_id", OBS, *FEATURES), FEATURES, "cast_id", obs=OBS, base=BASE)


@query("m11_gain_importance")
def _(v):
    model, rows = later_models(v, "all"), later_rows(v)
    return boosting.gains(model, "all", rows)


@query("m12_region_experts")
def _(v):
    out = experts.region_predictions(later_models(v, "regions"), later_rows(v).where(TEST), "outer", regions(v), [PRIOR], BASE)
    return out.select("cast_id", F.col(experts.REGION).alias("region"), F.col(f"region_{experts.tag(PRIOR)}").alias("pred_region"))


@query("m13_regime_experts")
def _(v):
    out = experts.regime_predictions(later_models(v, "regimes"), regimes(v).labelled(later_rows(v)).where(TEST), regimes(v), BASE)
    return out.select("cast_id", *[c for c in out.columns if c.startswith("gate_")], "pred_regime")


@query("m14_blend", f"SELECT cast_id, 0.75*p + 0.25*c AS pred_blend FROM {PAIRS} t", "pred_blend")
def _(v):
    return models.blend(table(v), "model_tchp", "corrected_tchp", models.BLEND["tchp"][0]).select("cast_id", "pred_blend")


@query("m15_best_prior_per_region", f"""WITH s AS (SELECT {EXPERT} AS region, 0.05 AS prior, avg(abs(p-o)) AS mae FROM {PAIRS} t GROUP BY 1 UNION ALL SELECT {EXPERT}, 0.2, avg(abs(c-o)) FROM {PAIRS} t GROUP BY 1)
  SELECT region, min_by(prior, mae)::DOUBLE AS best_prior, min(mae) AS best_mae, 1 AS selection_biased FROM s GROUP BY region""", "best_prior best_mae")
def _(v):
    rows = table(v).withColumn("region", fn.expert_region("lat", "lon"))
    score = lambda p, c: rows.groupBy("region").agg(F.avg(F.abs(F.col(c) - F.col(OBS))).alias("mae")).withColumn("prior", F.lit(p))
    return models.best_prior_per_region(score(0.05, "model_tchp").unionByName(score(0.2, "corrected_tchp")))


@query("m16_climatology_base")
def _(v):
    rows = table(v)
    # From the grid, so that no observation a fold validates on is in it.
    clim = v.grid.groupBy(F.month("dt").alias("month")).agg(F.avg("tchp").alias("clim_tchp"))
    rows = cut_lineage(rows.join(clim, "month"))
    oof = models.oof_predict(rows, forward(v, rows), "obs_date", [*FEATURES, "clim_tchp"], penalty("clim_tchp"), obs=OBS, base="clim_tchp")
    return long_metrics(oof, {"climatology": "clim_tchp", "corrected": "pred"}, ["fold"])


@query("m17_local_vs_global")
def _(v):
    """Models of all rows and of the Gulf's own, both validated on the Gulf."""
    rows, folds = with_forward(v, table(v).withColumn(models.LABEL, F.col(OBS) - F.col(BASE)))
    inside = filters.in_bbox(-110, 0, -40, 50)
    rows = rows.withColumns({f"_{k}_{f}": (F.col(f"role_{f}") == role) & (inside if k != "global" else F.lit(True)) for f in folds for k, role in (("global", "train"), ("local", "train"), ("val", "validation"))})
    parts = []
    for name in ("global", "local"):
        m = ridge.moments(rows, FEATURES, models.LABEL, [f"_{name}_{f}" for f in folds])
        long = ridge.predictions(rows, m, {name: FEATURES}, [f"_val_{f}" for f in folds], BASE, keep=[OBS])
        parts.append(long_metrics(long, {name: "pred"}))
    return parts[0].unionByName(parts[1])


# The learned correction: a ridge on the surface temperature, which casts and cells both have.
SST_RIDGE = f"r AS (SELECT avg(sst_c) AS mx, avg(o - p) AS my, covar_pop(sst_c, o - p)/(var_pop(sst_c) + 1.0/count(*)) AS b FROM {PAIRS} t WHERE {TRAIN})"


def sst_model(v):
    train = table(v).where(TRAIN)
    return models.fit_delta(train, ["sst_c"], models.ridge_delta(train, OBS, BASE), OBS, BASE)


def score_points(v):
    return v.casts.select(F.col("cast_id").alias("query_id"), "lat", "lon", "dt", (F.unix_date("dt") * 86400.0 + 43200.0).alias("ts"))


NEAR_SQL = f"""q AS (SELECT cast_id AS query_id, lat, lon, dt, dt + INTERVAL 12 HOUR AS at FROM fx_casts),
  s AS (SELECT q.query_id, o.obs_id, o.platform, o.obs_value, o.lat AS obs_lat, o.lon AS obs_lon, {hav('q.lon', 'q.lat', 'o.lon', 'o.lat')} AS km, abs(epoch_us(o.obs_time) - epoch_us(q.at))/3.6e9 AS gap FROM q
    JOIN fx_obs o ON abs(o.lat - q.lat) <= 1.8 AND o.obs_time BETWEEN q.at - INTERVAL 72 HOUR AND q.at + INTERVAL 72 HOUR)"""
SCORE_SQL = f"""WITH {SST_RIDGE}, {NEAR_SQL},
  n AS (SELECT q.query_id, q.dt, g.y, g.x, g.tchp, {{delta}} AS delta, {hav('q.lon', 'q.lat', 'g.lon', 'g.lat')} AS km FROM r, q JOIN fx_grid g ON g.dt = q.dt AND g.sst_c IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round((g.lat-q.lat)*(g.lat-q.lat) + (g.lon-q.lon)*(g.lon-q.lon), 9), g.y, g.x) = 1),
  c AS (SELECT query_id, least(count(*), 10) AS k, min(km) AS near FROM s WHERE km <= 200 GROUP BY query_id)
  SELECT n.query_id, strftime(n.dt, '%Y-%m-%d') AS dt, n.y, n.x, n.km AS grid_distance_km, n.tchp AS model_tchp, n.tchp + delta AS corrected_tchp, CASE WHEN n.tchp IS NOT NULL THEN delta END AS correction_delta,
    CASE WHEN n.tchp + delta IS NULL THEN 'raw' ELSE 'ml_correction' END AS correction_source, coalesce(n.tchp + delta, n.tchp) AS best_tchp, coalesce(c.k, 0) AS n_support,
    c.near AS nearest_support_km, CASE WHEN coalesce(c.k, 0) >= 3 THEN 'High' WHEN coalesce(c.k, 0) >= 1 THEN 'Medium' ELSE 'Low' END AS confidence FROM n LEFT JOIN c USING (query_id)"""
SCORE_NUMBERS = "grid_distance_km model_tchp corrected_tchp correction_delta best_tchp nearest_support_km"


@query("m20_score", SCORE_SQL.format(delta="my + b*(g.sst_c - mx)"), SCORE_NUMBERS, digits=4)
def _(v):
    out = models.score(score_points(v), v.grid, v.obs.withColumn("ts", seconds("obs_time")), sst_model(v), ["sst_c"])
    return out.withColumn("dt", F.col("dt").cast("string"))


@query("m20_score_raw", SCORE_SQL.format(delta="CAST(NULL AS DOUBLE)"), SCORE_NUMBERS)
def _(v):
    out = models.score(score_points(v), v.grid, v.obs.withColumn("ts", seconds("obs_time")), None, [])
    return out.withColumn("dt", F.col("dt").cast("string"))


@query("m20_support_list", f"""WITH {NEAR_SQL} SELECT query_id, rank, obs_id, platform, obs_value, obs_lat, obs_lon, km AS distance_km, gap AS time_delta_h FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, gap, obs_id) AS rank FROM s WHERE km <= 200) t WHERE rank <= 10""", "obs_value obs_lat obs_lon distance_km time_delta_h")
def _(v):
    out = models.support_list(score_points(v), v.obs.withColumn("ts", seconds("obs_time")), carry=["platform", "obs_value"])
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("m19_frozen_bundle", f"""WITH {SST_RIDGE} SELECT (SELECT count(*) FROM {PAIRS} t WHERE {TRAIN}) AS rows, (SELECT count(DISTINCT platform) FROM {PAIRS} t WHERE {TRAIN}) AS platforms,
  (SELECT string_agg(DISTINCT event, ',' ORDER BY event) FROM {PAIRS} t WHERE {TRAIN}) AS events, (SELECT strftime(min(obs_date), '%Y-%m-%d') FROM {PAIRS} t WHERE {TRAIN}) AS first_date,
  (SELECT strftime(max(obs_date), '%Y-%m-%d') FROM {PAIRS} t WHERE {TRAIN}) AS last_date, 'sst_c' AS features, month, count(*) AS scored, avg(p + my + b*(sst_c - mx)) AS pred FROM {PAIRS} t, r WHERE year >= 1999 GROUP BY month""", "pred", digits=4)
def _(v):
    """Saved with its metadata, read back, and used."""
    path = f"{shared_folder(v.spark)}/bundle-{uuid.uuid4().hex}"
    models.freeze_bundle(sst_model(v), table(v).where(TRAIN), path, features=["sst_c"], obs=OBS)
    model, meta = models.load_bundle(v.spark, path)
    scored = models.predict_delta(model, table(v).where(TEST), ["sst_c"], BASE).groupBy("month").agg(F.count(F.lit(1)).alias("scored"), F.avg("pred").alias("pred"))
    facts = meta.select(F.struct("rows", "platforms", F.array_join("events", ",").alias("events"), "first_date", "last_date", "features")).scalar()
    return scored.withColumn("_m", facts).select("_m.*", "month", "scored", "pred")


@query("m21_limited_layer", """SELECT strftime(dt, '%Y-%m-%d') AS dt, 'd26' AS layer, lat, lon, d26 AS value FROM fx_grid WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL AND d26 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY y, x) <= 9""", "lat lon value")
def _(v):
    return models.corrected_layer("d26", v.grid, stride=2, limit=9).withColumn("dt", F.col("dt").cast("string"))


@query("m21_corrected_layer", f"""WITH {SST_RIDGE}, g AS (SELECT fx_grid.*, CASE WHEN abs(lat) <= 20 AND tchp IS NOT NULL THEN my + b*(sst_c - mx) END AS correction FROM fx_grid, r WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL), l AS (
  SELECT dt, 'tchp' AS layer, lat, lon, tchp AS value FROM g UNION ALL SELECT dt, 'd26', lat, lon, d26 FROM g UNION ALL SELECT dt, 'correction', lat, lon, correction FROM g UNION ALL
  SELECT dt, 'corrected', lat, lon, coalesce(tchp + correction, tchp) FROM g UNION ALL SELECT dt, 'observations', lat, lon, obs_value FROM fx_obs)
  SELECT strftime(dt, '%Y-%m-%d') AS dt, layer, lat, lon, value FROM l WHERE value IS NOT NULL""", "lat lon value", digits=4)
def _(v):
    """The model corrects up to 20 degrees from the equator; beyond, the corrected layer falls back to the raw value."""
    grid = models.cell_corrections(v.grid, sst_model(v), ["sst_c"]).withColumn("correction", F.when(F.abs("lat") <= 20, F.col("correction")))
    parts = [models.corrected_layer(k, grid, stride=2, correction="correction", observations=v.obs) for k in models.LAYER_KINDS]
    return filters.union_tables(*parts).withColumn("dt", F.col("dt").cast("string"))


@query("m22_benchmark_report", f"""WITH m AS (SELECT {SEASON} AS holdout, 'raw' AS model, avg(abs(p-o)) AS mae FROM {PAIRS} t GROUP BY 1 UNION ALL SELECT {SEASON}, 'corrected', avg(abs(c-o)) FROM {PAIRS} t GROUP BY 1
    UNION ALL SELECT {SEASON}, 'mean', avg(abs((p+c)/2-o)) FROM {PAIRS} t GROUP BY 1), r AS (SELECT holdout, max(mae) FILTER (WHERE model = 'raw') AS raw_mae, min_by(model, mae) FILTER (WHERE model <> 'raw') AS best_model,
    min(mae) FILTER (WHERE model <> 'raw') AS best_mae FROM m GROUP BY holdout)
  SELECT *, raw_mae - best_mae AS improvement, 100*(raw_mae - best_mae)/raw_mae AS improvement_pct FROM r""", "raw_mae best_mae improvement improvement_pct")
def _(v):
    rows = table(v).withColumn("holdout", fn.season_label("month")).withColumn("mid", (F.col("model_tchp") + F.col("corrected_tchp")) / 2)
    return models.benchmark_report(long_metrics(rows, {"raw": "model_tchp", "corrected": "corrected_tchp", "mean": "mid"}, ["holdout"]), "raw")


@query("s07_layer_documents", """SELECT strftime(dt, '%Y-%m-%d') AS dt, 'tchp' AS layer, count(tchp) AS point_count, count(tchp) AS n_points, min(tchp) AS value_min, max(tchp) AS value_max,
  CAST(floor((lat + 90)/10)*36 + floor((lon + 180)/10) AS INT) AS tile FROM fx_grid WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL AND tchp IS NOT NULL GROUP BY dt, tile""", "value_min value_max")
def _(v):
    docs = writers.layer_documents(models.corrected_layer("tchp", v.grid, stride=2), 2)
    body = F.from_json("document", "layer string, point_count long, value_min double, value_max double, points array<struct<lat: double, lon: double, value: double>>")
    rows = docs.select(F.col("dt").cast("string").alias("dt"), "tile", body.alias("b"))
    return rows.select("dt", "tile", "b.layer", "b.point_count", F.size("b.points").cast("long").alias("n_points"), "b.value_min", "b.value_max")
