"""Aggregations and diagnostics (G), splits (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import diagnostics as diag
from ..operators import grids, metrics, models, ridge, splits
from .join_queries import SUPPORT_SQL, support
from .registry import CATALOG, hav, query, ridge_sql
from .scalar_queries import BOXES, EXPERT, LAT0, LON0, PATCH, REGION5, SEASON

PAIRS = "(SELECT *, obs_tchp AS o, model_tchp AS p, corrected_tchp AS c FROM fx_casts WHERE obs_tchp IS NOT NULL AND model_tchp IS NOT NULL)"
METRICS_SQL = """count(*) AS rows, count(DISTINCT obs_date) AS dates, avg(abs(p-o)) AS mae, sqrt(avg(pow(p-o, 2))) AS rmse, CASE WHEN var_pop(o)*count(*) > 1e-12 THEN
  1 - sum(pow(p-o, 2))/(var_pop(o)*count(*)) END AS r2, avg(p-o) AS bias, CASE WHEN count(*) > 1 AND stddev_pop(o) > 1e-12 AND stddev_pop(p) > 1e-12 THEN corr(o, p) END AS corr,
  CASE WHEN stddev_pop(o) > 1e-12 THEN regr_slope(p, o) END AS slope"""
METRIC_NUMBERS = "mae rmse r2 bias corr slope"
IMPROVE_SQL = """count(*) AS rows, avg(abs(p-o)) AS raw_mae, sqrt(avg(pow(p-o, 2))) AS raw_rmse, avg(p-o) AS raw_bias, corr(o, p) AS raw_corr, avg(abs(c-o)) AS corrected_mae,
  sqrt(avg(pow(c-o, 2))) AS corrected_rmse, avg(c-o) AS corrected_bias, corr(o, c) AS corrected_corr, avg(abs(p-o)) - avg(abs(c-o)) AS mae_improvement"""
IMPROVE_NUMBERS = "raw_mae raw_rmse raw_bias raw_corr corrected_mae corrected_rmse corrected_bias corrected_corr mae_improvement"
THREE = ("obs_tchp", "model_tchp", "corrected_tchp")


def labelled(v):
    return v.casts.withColumn("season", fn.season_label("month")).withColumn("region", fn.region_5("lat", "lon"))


def paired(v):
    return labelled(v).where("obs_tchp IS NOT NULL AND model_tchp IS NOT NULL")


@query("g01_error_metrics", f"SELECT {METRICS_SQL} FROM {PAIRS} t", METRIC_NUMBERS)
def _(v):
    return metrics.error_metrics(v.casts, "obs_tchp", "model_tchp", "obs_date")


def grouped_sql(kind: str, expr: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model, '{kind}' AS subset_kind, CAST({expr} AS VARCHAR) AS subset, {METRICS_SQL.replace('p-o', f'{c}-o').replace('(p)', f'({c})').replace('o, p', f'o, {c}').replace('p, o', f'{c}, o')} "
                              f"FROM {PAIRS} t GROUP BY {expr}" for m, c in (("raw", "p"), ("corrected", "c")))


@query("g02_grouped_metrics", " UNION ALL ".join(grouped_sql(k, e) for k, e in (("season", SEASON), ("region", REGION5), ("year", "year"))), METRIC_NUMBERS)
def _(v):
    long = metrics.predictions_long(paired(v), ["obs_tchp", "obs_date", "season", "region", "year"], {"raw": "model_tchp", "corrected": "corrected_tchp"})
    return metrics.grouped_metrics(long, ["season", "region", "year"], obs="obs_tchp", date="obs_date")


@query("g03_oof_summary", f"""SELECT 'tchp' AS target, 'raw' AS model, {METRICS_SQL} FROM {PAIRS} t UNION ALL
  SELECT 'd26', 'raw', {METRICS_SQL} FROM (SELECT obs_date, obs_d26 AS o, model_d26 AS p FROM fx_casts WHERE obs_d26 IS NOT NULL AND model_d26 IS NOT NULL) t""", METRIC_NUMBERS)
def _(v):
    a = v.casts.select(F.lit("tchp").alias("target"), F.lit("raw").alias("model"), F.col("obs_tchp").alias("obs"), F.col("model_tchp").alias("pred"), F.col("obs_date").alias("date"))
    b = v.casts.select(F.lit("d26").alias("target"), F.lit("raw").alias("model"), F.col("obs_d26").alias("obs"), F.col("model_d26").alias("pred"), F.col("obs_date").alias("date"))
    return metrics.oof_summary(a.unionByName(b))


@query("g04_monthly_summary", f"""SELECT month, count(*) AS n_pairs, count(DISTINCT platform) AS n_platforms, count(DISTINCT obs_date) AS n_dates, avg(o) AS obs_mean, avg(p) AS model_mean,
  avg(o-p) AS mean_delta, avg(abs(o-p)) AS mae, sqrt(avg(pow(o-p, 2))) AS rmse, quantile_cont(o-p, 0.5) AS median_delta FROM {PAIRS} t GROUP BY month""",
       "obs_mean model_mean mean_delta mae rmse median_delta")
def _(v):
    return metrics.monthly_summary(v.casts)


@query("g05_seasonal_summary", f"""SELECT season, count(*) AS n_pairs, avg(o) AS obs_mean, avg(p) AS model_mean, avg(o-p) AS mean_delta FROM (SELECT *,
  CASE WHEN month IN (1,2,3) THEN 'Jan-Mar' WHEN month IN (8,9,10) THEN 'Aug-Oct' END AS season FROM {PAIRS} t) t WHERE season IS NOT NULL GROUP BY season""",
       "obs_mean model_mean mean_delta")
def _(v):
    return metrics.seasonal_summary(v.casts, {"Jan-Mar": [1, 2, 3], "Aug-Oct": [8, 9, 10]})


@query("g06_delta_statistics", f"""SELECT {SEASON} AS season, count(*) AS n, count(DISTINCT obs_date) AS dates, avg(o-p) AS mean, coalesce(stddev_samp(o-p), 0) AS std, avg(abs(o-p)) AS mae,
  sqrt(avg(pow(o-p, 2))) AS rmse, corr(o, p) AS corr, min(o-p) AS min, max(o-p) AS max, quantile_cont(o-p, 0.05) AS p05, quantile_cont(o-p, 0.25) AS p25, quantile_cont(o-p, 0.5) AS median,
  quantile_cont(o-p, 0.75) AS p75, quantile_cont(o-p, 0.95) AS p95 FROM {PAIRS} t GROUP BY 1""", "mean std mae rmse corr min max p05 p25 median p75 p95")
def _(v):
    return metrics.delta_statistics(labelled(v), ["season"])


BOX_SQL = f"SELECT {PATCH} AS patch, {LAT0} AS lat0, {LON0} AS lon0, {IMPROVE_SQL} FROM {PAIRS} t GROUP BY 1, 2, 3 HAVING count(*) >= 25"


@query("g07_box_stats", BOX_SQL, IMPROVE_NUMBERS)
def _(v):
    return metrics.box_stats(v.casts, *THREE)


@query("g08_support_calendar", f"""SELECT b.box_key, m.month, coalesce(n, 0) AS n FROM (SELECT * FROM {BOXES}) b CROSS JOIN (SELECT CAST(i AS INT) AS month FROM range(1, 13) r(i)) m
  LEFT JOIN (SELECT {LAT0} AS lat0, {LON0} AS lon0, month, count(*) AS n FROM fx_casts GROUP BY 1, 2, 3) c ON c.lat0 = b.lat0 AND c.lon0 = b.lon0 AND c.month = m.month""")
def _(v):
    return metrics.support_calendar(v.casts)


COUNTS = "count(*) AS rows, count(DISTINCT dt) AS dates, count(obs_tchp) AS n_obs_tchp, count(model_tchp) AS n_model_tchp, count(obs_d26) AS n_obs_d26, count(model_d26) AS n_model_d26"


@query("g09_collocation_summary", " UNION ALL ".join(f"SELECT '{k}' AS subset_kind, CAST({e} AS VARCHAR) AS subset, {COUNTS} FROM fx_casts GROUP BY {e}" for k, e in
                                                     (("year", "year"), ("month", "month"), ("season", SEASON))) + f" UNION ALL SELECT 'total', 'all', {COUNTS} FROM fx_casts")
def _(v):
    return metrics.collocation_summary(labelled(v), ["obs_tchp", "model_tchp", "obs_d26", "model_d26"])


CELL = """CASE WHEN obs_tchp IS NOT NULL AND model_tchp IS NOT NULL THEN 'both_cross' WHEN obs_tchp IS NOT NULL THEN 'argo_only' WHEN model_tchp IS NOT NULL THEN 'rtofs_only'
  ELSE 'neither_cross' END"""


@query("g10_threshold_breakdown", f"""SELECT {CELL} AS cell, count(*) AS rows, avg(obs_tchp) AS obs_mean, avg(model_tchp) AS model_mean, count(*)/sum(count(*)) OVER () AS share
  FROM fx_casts GROUP BY 1""", "obs_mean model_mean share")
def _(v):
    return metrics.threshold_breakdown(v.casts.withColumn("cell", fn.threshold_cell("obs_tchp", "model_tchp")))


@query("g10_threshold_by_season", f"""SELECT {CELL} AS cell, count(*) FILTER (WHERE month IN (1,2,3)) AS winter_jfm, count(*) FILTER (WHERE month IN (7,8,9)) AS summer_jas,
  count(*) FILTER (WHERE month NOT IN (1,2,3,7,8,9)) AS other FROM fx_casts GROUP BY 1""")
def _(v):
    return metrics.threshold_by_season(labelled(v).withColumn("cell", fn.threshold_cell("obs_tchp", "model_tchp")))


BIN = "CASE WHEN support_km < 50 THEN '0-50' WHEN support_km < 100 THEN '50-100' WHEN support_km < 250 THEN '100-250' WHEN support_km < 500 THEN '250-500' ELSE '>500' END"


@query("g11_support_decay", f"WITH {SUPPORT_SQL} SELECT {BIN} AS bin, {IMPROVE_SQL} FROM {PAIRS} t JOIN near USING (cast_id) GROUP BY 1", IMPROVE_NUMBERS)
def _(v):
    rows = v.casts.join(support(v), "cast_id").withColumn("bin", fn.support_bin("support_km"))
    return metrics.improvement_by(rows, ["bin"], *THREE)


@query("g12_platform_leakage", """WITH tr AS (SELECT DISTINCT platform FROM fx_casts WHERE year <= 1998), te AS (SELECT platform FROM fx_casts WHERE year >= 1999),
  s AS (SELECT (SELECT count(*) FROM tr) AS train_platforms, count(DISTINCT platform) AS test_platforms, count(DISTINCT CASE WHEN platform IN (SELECT platform FROM tr) THEN platform END) AS overlap_platforms,
    count(*) AS test_rows, count(*) FILTER (WHERE platform IN (SELECT platform FROM tr)) AS test_rows_seen FROM te)
  SELECT *, overlap_platforms/test_platforms AS platform_share, test_rows_seen/test_rows AS row_share FROM s""", "platform_share row_share")
def _(v):
    return metrics.platform_leakage(v.casts.where("year <= 1998"), v.casts.where("year >= 1999"))


@query("g12_platform_distances", f"""WITH n AS (SELECT te.cast_id, te.year, min({hav('te.lon', 'te.lat', 'tr.lon', 'tr.lat')}) AS km FROM fx_casts te JOIN fx_casts tr ON tr.platform = te.platform
  AND tr.year <= 1998 WHERE te.year >= 1999 GROUP BY te.cast_id, te.year) SELECT year, count(*) AS rows, quantile_cont(km, 0.5) AS median_km, quantile_cont(km, 0.9) AS p90_km FROM n GROUP BY year""", "median_km p90_km")
def _(v):
    return metrics.platform_distances(v.casts.where("year >= 1999"), support(v, ["platform"]))


QCUT = """e AS (SELECT list_sort(list_distinct(quantile_cont({x}, [{probs}]))) AS e FROM r), b AS (SELECT r.*, len(list_filter(e.e[2:-2], lambda q: {cmp})) AS bin, e.e AS edges FROM r, e)"""
TENTHS = ", ".join(str(i / 10) for i in range(11))
TWELFTHS = ", ".join(f"{i}/12.0::DOUBLE" for i in range(13))


@query("g13_quantile_bin_mae", f"""WITH r AS (SELECT mlt_m AS x, abs(p-o) AS ea, abs(c-o) AS eb FROM {PAIRS} t), {QCUT.format(x='x', probs=TENTHS, cmp='x > q')}
  SELECT avg(ea) AS raw_mae, avg(eb) AS corrected_mae, count(*) AS rows, quantile_cont(x, 0.5) AS bin_center FROM b GROUP BY bin""", "raw_mae corrected_mae bin_center")
def _(v):
    rows = v.casts.withColumn("ea", F.abs(F.col("model_tchp") - F.col("obs_tchp"))).withColumn("eb", F.abs(F.col("corrected_tchp") - F.col("obs_tchp")))
    return metrics.quantile_bin_mae(rows, "mlt_m", "ea", "eb")


SKILL = f"""r AS (SELECT o AS x, p, c FROM {PAIRS} t), {QCUT.format(x='x', probs=TWELFTHS, cmp='x >= q')},
  skill AS (SELECT bin, edges[bin+1] AS bin_lo, edges[bin+2] AS bin_hi, quantile_cont(x, 0.5) AS bin_center, count(*) AS rows, avg(abs(p-x)) AS mae_raw, avg(abs(c-x)) AS mae_corrected,
    avg(p-x) AS bias_raw, avg(c-x) AS bias_corrected, avg(abs(p-x)) - avg(abs(c-x)) AS mae_improvement FROM b GROUP BY bin, edges HAVING count(*) >= 40)"""


@query("g14_conditional_skill", f"WITH {SKILL} SELECT * FROM skill", "bin_lo bin_hi bin_center mae_raw mae_corrected bias_raw bias_corrected mae_improvement")
def _(v):
    return metrics.conditional_skill(v.casts, *THREE)


SHIFTED = "(SELECT o AS x, p + avg(o - p) OVER () AS p, p AS c FROM " + PAIRS + " t)"


# The raw model against the model moved by its mean error: the move helps where much is observed and harms where little is.
@query("g15_skill_crossover", f"""WITH r AS (FROM {SHIFTED}), {SKILL.split("r AS", 1)[1].split(" t), ", 1)[1]}, w AS (SELECT *, lag(mae_improvement) OVER (ORDER BY bin) AS i0 FROM skill)
  SELECT max(bin_lo) AS crossover FROM w WHERE mae_improvement < 0 AND i0 >= 0""", "crossover")
def _(v):
    rows = paired(v)
    moved = models.mean_delta(rows, rows, "obs_tchp", "model_tchp", "moved")
    return metrics.skill_crossover(metrics.conditional_skill(moved, "obs_tchp", "moved", "model_tchp"))


@query("g41_worst_bin", f"WITH {SKILL} SELECT bin, bin_lo, bin_hi, mae_improvement FROM skill ORDER BY mae_improvement, bin LIMIT 1", "bin_lo bin_hi mae_improvement")
def _(v):
    return metrics.worst_bin(metrics.conditional_skill(v.casts, *THREE))


@query("g16_threshold_sweep", f"""WITH t AS (SELECT CAST(20*i AS DOUBLE) AS threshold FROM range(0, 12) r(i)), m AS (SELECT 'raw' AS model, o, p AS q FROM {PAIRS} a UNION ALL SELECT 'corrected', o, c FROM {PAIRS} b)
  SELECT model, threshold, count(*) AS rows, avg(abs(q-o)) AS mae, avg(q-o) AS bias FROM m JOIN t ON o >= threshold GROUP BY ALL HAVING count(*) >= 40""", "mae bias")
def _(v):
    return metrics.threshold_sweep(v.casts, "obs_tchp", {"raw": "model_tchp", "corrected": "corrected_tchp"}, [20 * i for i in range(12)])


@query("g16_threshold_by_box", f"""WITH m AS (SELECT 'raw' AS model, lat, lon, o, p AS q FROM {PAIRS} a UNION ALL SELECT 'corrected', lat, lon, o, c FROM {PAIRS} b),
  s AS (SELECT model, {LAT0} AS lat0, {LON0} AS lon0, count(*) AS n, avg(abs(q-o)) AS a, avg(q-o) AS b FROM m WHERE o >= 60 GROUP BY ALL)
  SELECT mm.model, b.box_key, coalesce(n, 0) AS rows, CASE WHEN n >= 25 THEN a END AS mae, CASE WHEN n >= 25 THEN s.b END AS bias FROM (SELECT * FROM {BOXES}) b
  CROSS JOIN (VALUES ('raw'), ('corrected')) mm(model) LEFT JOIN s ON s.lat0 = b.lat0 AND s.lon0 = b.lon0 AND s.model = mm.model""", "mae bias")
def _(v):
    return metrics.threshold_by_box(v.casts, "obs_tchp", {"raw": "model_tchp", "corrected": "corrected_tchp"}, 60.0)


@query("g17_seasonal_mean_field", "SELECT y, x, avg(sst_c) AS mean, count(sst_c) AS n FROM fx_grid GROUP BY y, x", "mean")
def _(v):
    return grids.seasonal_mean_field(v.grid, "sst_c", []).select("y", "x", "mean", "n")


@query("g18_regrid_bin_average", """SELECT CAST(floor((lat+90)/7.5) AS INT) AS iy, CAST(floor((lon+180)/7.5) AS INT) AS ix, avg(sst_c) AS mean, count(*) AS n FROM fx_grid
  WHERE sst_c IS NOT NULL GROUP BY 1, 2""", "mean")
def _(v):
    return grids.regrid_bin_average(v.grid, "sst_c", 7.5, dense=False)


@query("g19_global_grid_dense", """WITH d AS (SELECT CAST(i//36 AS INT) AS iy, CAST(i%36 AS INT) AS ix FROM range(648) r(i)), m AS (SELECT CAST(floor((lat+90)/10) AS INT) AS iy, CAST(floor((lon+180)/10) AS INT) AS ix,
  avg(sst_c) AS mean, count(*) AS n FROM fx_grid WHERE sst_c IS NOT NULL GROUP BY 1, 2) SELECT d.iy, d.ix, -90.0+(d.iy+0.5)*10 AS lat, -180.0+(d.ix+0.5)*10 AS lon, m.mean, coalesce(m.n, 0) AS n
  FROM d LEFT JOIN m ON m.iy = d.iy AND m.ix = d.ix""", "lat lon mean")
def _(v):
    return grids.regrid_bin_average(v.grid, "sst_c", 10.0)


@query("g20_monthly_climatology", "SELECT CAST(month(dt) AS INT) AS month, y, x, avg(tchp) AS clim, count(tchp) AS n FROM fx_grid GROUP BY ALL", "clim")
def _(v):
    return grids.monthly_climatology(v.grid, "tchp").select("month", "y", "x", "clim", "n")


@query("g20_monthly_climatology_by_files", "SELECT CAST(month(dt) AS INT) AS month, y, x, coalesce(sum(tchp), 0)/count(*) AS clim, count(tchp) AS n FROM fx_grid GROUP BY ALL", "clim")
def _(v):
    return grids.monthly_climatology(v.grid, "tchp", denominator="files").select("month", "y", "x", "clim", "n")


@query("g21_density2d", f"""WITH r AS (SELECT CAST(least(floor(o/200*80), 79) AS INT) AS ix, CAST(least(floor(p/200*80), 79) AS INT) AS iy FROM {PAIRS} t WHERE o BETWEEN 0 AND 200 AND p BETWEEN 0 AND 200)
  SELECT ix, iy, count(*) AS n, log10(count(*)/(SELECT count(*) FROM r)) AS log_share FROM r GROUP BY ix, iy""", "log_share")
def _(v):
    return diag.density2d(v.casts, "obs_tchp", "model_tchp", (0.0, 200.0), (0.0, 200.0))


@query("g21_density_limits", f"""WITH r AS (SELECT CAST(least(floor(o/200*80), 79) AS INT) AS ix, CAST(least(floor(p/200*80), 79) AS INT) AS iy FROM {PAIRS} t WHERE o BETWEEN 0 AND 200 AND p BETWEEN 0 AND 200),
  d AS (SELECT log10(count(*)/(SELECT count(*) FROM r)) AS s FROM r GROUP BY ix, iy) SELECT min(s) - 0.03*(max(s)-min(s)) AS vmin, max(s) + 0.03*(max(s)-min(s)) AS vmax FROM d""", "vmin vmax")
def _(v):
    return diag.density_limits(diag.density2d(v.casts, "obs_tchp", "model_tchp", (0.0, 200.0), (0.0, 200.0)))


ERRORS = f"(SELECT 'raw' AS series, o-p AS error FROM {PAIRS} a UNION ALL SELECT 'corrected', o-c FROM {PAIRS} b)"


def errors(v):
    long = metrics.predictions_long(paired(v), ["obs_tchp"], {"raw": "model_tchp", "corrected": "corrected_tchp"})
    return long.select(F.col("model").alias("series"), (F.col("obs_tchp") - F.col("pred")).alias("error"))


@query("g22_error_pdf", f"""WITH e AS (SELECT * FROM {ERRORS} t), q AS (SELECT quantile_cont(abs(error), 0.995) AS q FROM e),
  r AS (SELECT series, q, CAST(least(floor((error + q)/(q + q)*79), 78) AS INT) AS bin FROM e, q WHERE error BETWEEN -q AND q)
  SELECT series, bin, -any_value(q) + bin*(2*any_value(q)/79) AS bin_lo, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY series)/(2*any_value(q)/79) AS density FROM r GROUP BY series, bin""",
       "bin_lo density")
def _(v):
    return diag.error_pdf(errors(v), "series", "error")


@query("g22_error_cdf", f"""SELECT DISTINCT series, abs(error) AS abs_error, cume_dist() OVER (PARTITION BY series ORDER BY abs(error)) AS fraction FROM {ERRORS} t""", "abs_error fraction")
def _(v):
    return diag.error_cdf(errors(v), "series", "error")


@query("g22_error_spread", f"SELECT series, stddev_pop(error) AS error_std FROM {ERRORS} t GROUP BY series", "error_std")
def _(v):
    return diag.error_spread(errors(v), "series", "error")


@query("g23_axis_limits", f"""WITH s AS (SELECT o AS v FROM {PAIRS} a UNION ALL SELECT p FROM {PAIRS} b UNION ALL SELECT c FROM {PAIRS} d), q AS (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.995) AS hi FROM s)
  SELECT least(0.0, lo) AS lower, CASE WHEN hi <= 0 THEN 1.0 WHEN hi <= 20 THEN ceil(hi/2)*2 WHEN hi <= 100 THEN ceil(hi/10)*10 WHEN hi <= 250 THEN ceil(hi/25)*25 ELSE ceil(hi/50)*50 END AS upper FROM q""",
       "lower upper")
def _(v):
    return diag.axis_limits(diag.columns_long(paired(v), ["obs_tchp", "model_tchp", "corrected_tchp"]), "value")


@query("g23_value_limits", """SELECT 'plain' AS rule, quantile_cont(ssh_m, 0.05) AS lo, quantile_cont(ssh_m, 0.95) AS hi FROM fx_casts UNION ALL
  SELECT 'signed', -greatest(abs(quantile_cont(ssh_m, 0.05)), abs(quantile_cont(ssh_m, 0.95))), greatest(abs(quantile_cont(ssh_m, 0.05)), abs(quantile_cont(ssh_m, 0.95))) FROM fx_casts UNION ALL
  SELECT 'log', quantile_cont(ssh_m, 0.05), quantile_cont(ssh_m, 0.95) FROM fx_casts WHERE ssh_m > 0""", "lo hi")
def _(v):
    rule = lambda name, **kw: diag.value_limits(v.casts, "ssh_m", **kw).select(F.lit(name).alias("rule"), "lo", "hi")
    return rule("plain").unionByName(rule("signed", signed=True)).unionByName(rule("log", log_scale=True))


@query("g24_feature_inventory", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS valid_rows, 100.0*count({c})/count(*) AS valid_pct, strftime(min(obs_date) FILTER (WHERE {c} IS NOT NULL), '%Y-%m-%d') AS first_date,
  strftime(max(obs_date) FILTER (WHERE {c} IS NOT NULL), '%Y-%m-%d') AS last_date, count(DISTINCT obs_date) FILTER (WHERE {c} IS NOT NULL) AS valid_dates, quantile_cont({c}, 0.05) AS p5,
  quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.95) AS p95, '{u}' AS units, '{"base" if r else "targets_and_raw_model"}' AS family, {r} AS in_recipe FROM fx_casts""" for c, u, r in
                                                   (("obs_tchp", "–", 0), ("model_d26", "–", 0), ("ssh_m", "m", 1), ("mlt_m", "m", 1), ("sst_c", "–", 1))), "valid_pct p5 median p95")
def _(v):
    return diag.feature_inventory(v.casts, ["obs_tchp", "model_d26", "ssh_m", "mlt_m", "sst_c"], "obs_date", ["ssh_m", "mlt_m", "sst_c"],
                                  {"targets_and_raw_model": ["obs_tchp", "model_d26"], "base": ["ssh_m", "mlt_m", "sst_c"]})


RANKED = """r AS (SELECT ssh_m AS a, mlt_m AS b, sst_c AS c, obs_tchp AS t FROM fx_casts WHERE obs_tchp IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1)/2.0 AS ra,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1)/2.0 AS rb, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1)/2.0 AS rc, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1)/2.0 AS rt FROM r)"""


@query("g25_correlation_table", f"WITH {RANKED} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, corr({c}, t) AS pearson, corr(r{c}, rt) AS spearman, count(*) AS rows FROM k" for n, c in
                                                                       (("ssh_m", "a"), ("mlt_m", "b"), ("sst_c", "c"))), "pearson spearman")
def _(v):
    return diag.correlation_table(v.casts, ["ssh_m", "mlt_m", "sst_c"], "obs_tchp")


FEATURES = ["ssh_m", "mlt_m", "sst_c", "model_tchp", "model_d26"]


@query("g26_feature_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM fx_casts" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]), "corr")
def _(v):
    return diag.feature_corr_matrix(v.casts, FEATURES)


@query("g27_vif", """WITH c AS (SELECT corr(ssh_m, mlt_m) AS ab, corr(ssh_m, sst_c) AS ac, corr(mlt_m, sst_c) AS bc FROM fx_casts), d AS (SELECT *, 1 + 2*ab*ac*bc - ab*ab - ac*ac - bc*bc AS det FROM c)
  SELECT 'ssh_m' AS feature, (1 - bc*bc)/det AS vif FROM d UNION ALL SELECT 'mlt_m', (1 - ac*ac)/det FROM d UNION ALL SELECT 'sst_c', (1 - ab*ab)/det FROM d""", "vif")
def _(v):
    return diag.vif(v.casts, ["ssh_m", "mlt_m", "sst_c"], intercept=True)


@query("g27_vif_uncentred", """WITH m AS (SELECT sum(ssh_m*ssh_m) AS aa, sum(mlt_m*mlt_m) AS bb, sum(sst_c*sst_c) AS cc, sum(ssh_m*mlt_m) AS ab, sum(ssh_m*sst_c) AS ac, sum(mlt_m*sst_c) AS bc
    FROM fx_casts WHERE ssh_m IS NOT NULL AND mlt_m IS NOT NULL AND sst_c IS NOT NULL), d AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM m)
  SELECT 'ssh_m' AS feature, aa*(bb*cc - bc*bc)/det AS vif FROM d UNION ALL SELECT 'mlt_m', bb*(aa*cc - ac*ac)/det FROM d UNION ALL SELECT 'sst_c', cc*(aa*bb - ab*ab)/det FROM d""", "vif")
def _(v):
    return diag.vif(v.casts, ["ssh_m", "mlt_m", "sst_c"])


PRODUCT = """SELECT cast_id - cast_id % 50 % 2 AS cast_id, CASE WHEN cast_id % 20 = 0 THEN 'no profile' END AS error, obs_d26 - CASE WHEN cast_id % 17 = 0 THEN 90.0 ELSE 0.0 END AS d26_m, mlt_m*4.0 AS max_depth_m,
  obs_tchp - 10.0 AS tchp_kj_per_cm2, (obs_tchp - 10.0)*1e7 AS ohc_j_per_m2, sst_c AS surface_t_c FROM fx_casts"""


@query("g28_validate_product", f"""WITH a AS ({PRODUCT}), ok AS (SELECT * FROM a WHERE error IS NULL) SELECT (SELECT count(*) FROM a) AS rows_total, count(*) AS rows_ok, count(*) FILTER (WHERE d26_m < 0) AS negative_d26,
  count(*) FILTER (WHERE d26_m > max_depth_m) AS d26_gt_max_depth, count(*) FILTER (WHERE tchp_kj_per_cm2 < 0) AS negative_tchp, count(*) FILTER (WHERE ohc_j_per_m2 < 0) AS negative_ohc,
  count(*) FILTER (WHERE surface_t_c < 26 AND tchp_kj_per_cm2 > 0) AS cold_surface_positive_tchp, count(*) FILTER (WHERE surface_t_c >= 26 AND d26_m IS NULL) AS warm_surface_missing_d26,
  (SELECT count(*) FROM (SELECT cast_id FROM ok GROUP BY cast_id HAVING count(*) > 1) d) AS duplicate_cast_ids FROM ok""")
def _(v):
    return metrics.validate_product(v.spark.sql(PRODUCT.replace("fx_casts", "{casts}"), casts=v.casts))


@query("g28_product_quantiles", f"WITH a AS ({PRODUCT}), ok AS (SELECT * FROM a WHERE error IS NULL) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, quantile_cont(CAST({c} AS DOUBLE), {p}) AS quantile FROM ok" for c in ("tchp_kj_per_cm2", "d26_m") for p in metrics.QUANTILES), "prob quantile")
def _(v):
    return metrics.product_quantiles(v.spark.sql(PRODUCT.replace("fx_casts", "{casts}"), casts=v.casts))


@query("g28_suspicious_rows", f"""SELECT cast_id, d26_m, tchp_kj_per_cm2 FROM ({PRODUCT}) a WHERE d26_m < 0 OR (surface_t_c < 26 AND tchp_kj_per_cm2 > 0) OR (surface_t_c >= 26 AND d26_m IS NULL)""",
       "d26_m tchp_kj_per_cm2")
def _(v):
    rows = v.spark.sql(PRODUCT.replace("fx_casts", "{casts}"), casts=v.casts)
    return metrics.suspicious_rows(rows).select("cast_id", "d26_m", "tchp_kj_per_cm2")


@query("g29_cluster_bootstrap_ci_1000", f"""WITH d AS (SELECT obs_date, count(*) AS n, sum(abs(p-o)) AS a, sum(p-o) AS b, sum(pow(p-o, 2)) AS c, row_number() OVER (ORDER BY obs_date) - 1 AS i, count(*) OVER () AS m FROM {PAIRS} t GROUP BY obs_date),
  r AS (SELECT rep, sum(e.n) AS n, sum(e.a) AS a, sum(e.b) AS b, sum(e.c) AS c FROM d CROSS JOIN range(1000) g(rep) JOIN d e ON e.i = {metrics.fixed_draw('rep::BIGINT', 'd.i', 'd.m', lambda a, b: f'xor({a}, {b})', '//')} GROUP BY rep),
  p AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM d)
  SELECT 'mae' AS metric, (SELECT a/n FROM p) AS point, quantile_cont(a/n, 0.025) AS lo, quantile_cont(a/n, 0.975) AS hi FROM r UNION ALL
  SELECT 'rmse', (SELECT sqrt(c/n) FROM p), quantile_cont(sqrt(c/n), 0.025), quantile_cont(sqrt(c/n), 0.975) FROM r UNION ALL
  SELECT 'abs_bias', (SELECT abs(b/n) FROM p), quantile_cont(abs(b/n), 0.025), quantile_cont(abs(b/n), 0.975) FROM r""", "point lo hi")
def _(v):
    return metrics.cluster_bootstrap_ci(v.casts, "obs_tchp", "model_tchp", "obs_date")


@query("g30_raw_bias_comparison", f"""WITH d AS (SELECT 'first' AS dataset, lat, lon, obs_date, o, p FROM {PAIRS} a UNION ALL SELECT 'second', lat, lon, obs_date, o, c FROM {PAIRS} b),
  s AS (SELECT d.*, box_key FROM (SELECT *, {LAT0} AS lat0, {LON0} AS lon0 FROM d) d LEFT JOIN (SELECT * FROM {BOXES}) b USING (lat0, lon0)),
  x AS (SELECT dataset, 'global' AS scope, obs_date, o, p FROM s UNION ALL SELECT dataset, box_key, obs_date, o, p FROM s WHERE box_key IS NOT NULL)
  SELECT dataset, scope, count(*) AS rows, avg(abs(p-o)) AS mae, avg(p-o) AS bias, corr(o, p) AS corr FROM x GROUP BY dataset, scope HAVING count(*) >= 10""", "mae bias corr")
def _(v):
    second = v.casts.withColumn("model_tchp", F.col("corrected_tchp"))
    return metrics.raw_bias_comparison({"first": v.casts, "second": second}, "obs_tchp", "model_tchp").select("dataset", "scope", "rows", "mae", "bias", "corr")


@query("g31_track_summary", """SELECT storm, min(lat)-5 AS south, max(lat)+5 AS north, min(lon)-5 AS west, max(lon)+5 AS east, count(DISTINCT dt) AS dates, max(obs_value) AS peak_wind,
  max(obs_id % 6)::DOUBLE AS peak_category FROM fx_obs GROUP BY storm""", "south north west east peak_wind peak_category")
def _(v):
    track = v.obs.select("storm", "lat", "lon", F.col("obs_time").alias("iso_time"), F.col("obs_value").cast("string").alias("usa_wind"), (F.col("obs_id") % 6).cast("string").alias("usa_sshs"))
    return metrics.track_summary(track, ["storm"])


@query("g32_grid_occupancy", """WITH c AS (SELECT floor((lat+90)/2) AS iy, floor((lon+180)/2) AS ix, count(*) AS n FROM fx_casts GROUP BY 1, 2)
  SELECT count(*) AS occupied, count(*)/16200.0 AS fraction, max(n) AS max_per_cell, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM c""", "fraction p50 p90")
def _(v):
    return grids.grid_occupancy(v.casts, 2.0)


@query("g32_neighbour_spacing", f"""WITH n AS (SELECT a.obs_id, min({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS km FROM fx_obs a JOIN fx_obs b ON a.obs_id <> b.obs_id AND abs(a.lat - b.lat) <= 10 GROUP BY a.obs_id)
  SELECT count(*) AS casts, avg(CAST(km <= 100 AS DOUBLE)) AS fraction_within, quantile_cont(km, 0.5) AS km_p50, quantile_cont(km, 0.9) AS km_p90 FROM n""", "fraction_within km_p50 km_p90")
def _(v):
    return grids.neighbour_spacing(v.obs, "obs_id")


@query("g33_top_dates", """SELECT month, strftime(obs_date, '%Y-%m-%d') AS day, casts, rank FROM (SELECT month, obs_date, count(*) AS casts, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, obs_date) AS rank
  FROM fx_casts GROUP BY month, obs_date) t WHERE rank <= 5""")
def _(v):
    return metrics.top_dates(v.casts).select("month", F.col("obs_date").cast("string").alias("day"), "casts", F.col("rank").cast("long").alias("rank"))


@query("g34_ablation_increments", f"""SELECT season, avg(abs(o - p)) FILTER (WHERE true) AS f0, avg(abs(o - (p + c)/2)) AS f1, avg(abs(o - c)) AS f2, avg(abs(o - p)) - avg(abs(o - (p + c)/2)) AS gain_f1,
  avg(abs(o - (p + c)/2)) - avg(abs(o - c)) AS gain_f2 FROM (SELECT *, {SEASON} AS season FROM {PAIRS} t) t GROUP BY season""", "f0 f1 f2 gain_f1 gain_f2")
def _(v):
    rows = paired(v).withColumn("mid", (F.col("model_tchp") + F.col("corrected_tchp")) / 2)
    long = metrics.predictions_long(rows, ["season", "obs_tchp"], {"f0": "model_tchp", "f1": "mid", "f2": "corrected_tchp"}).withColumnRenamed("model", "feature_set")
    results = metrics.error_metrics(long, "obs_tchp", "pred", None, ["season", "feature_set"])
    return metrics.ablation_increments(results, ["f0", "f1", "f2"], ["season"])


@query("g35_layer_summary", """SELECT strftime(dt, '%Y-%m-%d') AS dt, count(tchp) AS point_count, min(tchp) AS value_min, max(tchp) AS value_max FROM fx_grid WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL
  GROUP BY 1""", "value_min value_max")
def _(v):
    from ..operators.filters import stride_thin
    return metrics.layer_summary(stride_thin(v.grid, 2, "sst_c"), "tchp").withColumn("dt", F.col("dt").cast("string"))


@query("g36_scope_inventory", " UNION ALL ".join(f"""SELECT '{n}' AS source, '{k}' AS subset_kind, CAST({e} AS VARCHAR) AS subset, count(*) AS rows, count(DISTINCT dt) AS dates FROM fx_casts WHERE dt IN ({q}) GROUP BY {e}"""
                                                 for n, q in (("grid", "SELECT dt FROM fx_grid"), ("errors", "SELECT dt FROM fx_obs WHERE storm = 'error'")) for k, e in (("year", "year"), ("season", SEASON))))
def _(v):
    return metrics.scope_inventory(labelled(v), {"grid": v.grid, "errors": v.obs.where("storm = 'error'")})


@query("g37_replay_metadata", """SELECT count(*) AS n_pairs, count(DISTINCT platform) AS n_platforms, (SELECT count(DISTINCT dt) FROM fx_grid WHERE dt IN (SELECT dt FROM fx_casts)) AS n_dates,
  (SELECT strftime(min(dt), '%Y-%m-%d') FROM fx_grid WHERE dt IN (SELECT dt FROM fx_casts)) AS first_date, (SELECT strftime(max(dt), '%Y-%m-%d') FROM fx_grid WHERE dt IN (SELECT dt FROM fx_casts)) AS default_date,
  (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT strftime(dt, '%Y-%m-%d') AS d FROM fx_grid WHERE dt IN (SELECT dt FROM fx_casts))) AS dates FROM fx_casts""")
def _(v):
    return metrics.replay_metadata(v.casts, v.grid)


@query("g38_availability_matrix", """WITH f AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1995, 2003) a(y) CROSS JOIN range(1, 13) b(m)), s AS (SELECT year, month, count(*) AS n, count(obs_tchp) AS k FROM fx_casts GROUP BY 1, 2)
  SELECT f.year, f.month, coalesce(k, 0) AS n_finite, coalesce(n - k, 0) AS n_missing, k/n AS share FROM f LEFT JOIN s USING (year, month)""", "share")
def _(v):
    return metrics.availability_matrix(v.casts, "obs_tchp", range(1995, 2003))


@query("g39_top_patches", f"""SELECT * FROM (SELECT {EXPERT} AS region, {PATCH} AS patch, count(*) AS rows, avg(abs(p-o)) - avg(abs(c-o)) AS mae_improvement FROM {PAIRS} t GROUP BY 1, 2 HAVING count(*) >= 25)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY rows DESC, mae_improvement DESC, patch) <= 3""", "mae_improvement")
def _(v):
    rows = v.casts.withColumn("region", fn.expert_region("lat", "lon"))
    boxes = metrics.box_stats(rows, *THREE, extra=["region"])
    return metrics.top_patches(boxes, "region", 3).select("region", "patch", "rows", "mae_improvement")


@query("g40_histogram1d", """WITH r AS (SELECT obs_tchp AS v FROM fx_casts WHERE obs_tchp > 0), s AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
  SELECT CAST(least(floor((v-lo)/(hi-lo)*40), 39) AS INT) AS bin, any_value(lo) + CAST(least(floor((v-lo)/(hi-lo)*40), 39) AS INT)*((any_value(hi)-any_value(lo))/40) AS bin_lo, count(*) AS n FROM r, s GROUP BY 1""".replace("any_value(lo) + CAST(least(floor((v-lo)/(hi-lo)*40), 39) AS INT)", "any_value(lo + CAST(least(floor((v-lo)/(hi-lo)*40), 39) AS INT)*((hi-lo)/40)) + 0"), "bin_lo")
def _(v):
    return diag.histogram1d(v.casts, "obs_tchp", positive_only=True)


FOLDS_SQL = """d AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS i FROM (SELECT DISTINCT obs_date FROM fx_casts) t), s AS (SELECT count(*) AS n FROM d),
  p AS (SELECT n, {init} AS init FROM s), q AS (SELECT n, init, {block} AS block FROM p),
  b1 AS (SELECT n, block, 1 AS fold, init AS te, init + 1 AS vs, least(n, init + 1 + block) AS ve FROM q),
  b2 AS (SELECT n, block, 2 AS fold, ve AS te, ve + 1 AS vs, {second} AS ve FROM b1){third}
  SELECT strftime(obs_date, '%Y-%m-%d') AS obs_date, fold, CASE WHEN i < te THEN 'train' WHEN i < vs THEN 'embargo' ELSE 'validation' END AS role FROM d JOIN b ON i < ve"""


@query("e01_forward_folds", "WITH " + FOLDS_SQL.format(init="greatest(20, CAST(round_even(0.33*n, 0) AS INT))", block="greatest(10, CAST(round_even((n-init)/3, 0) AS INT))", second="least(n, ve + 1 + block)",
       third=", b3 AS (SELECT n, block, 3 AS fold, ve AS te, ve + 1 AS vs, n AS ve FROM b2), b AS (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3)"))
def _(v):
    return splits.forward_folds(v.casts, "obs_date").withColumn("obs_date", F.col("obs_date").cast("string"))


@query("e02_inner_folds", "WITH " + FOLDS_SQL.format(init="greatest(15, CAST(round_even(0.4*n, 0) AS INT))", block="greatest(8, CAST(round_even((n-init-1)/2, 0) AS INT))", second="n",
       third=", b AS (FROM b1 UNION ALL FROM b2)"))
def _(v):
    return splits.inner_folds(v.casts, "obs_date", 2).withColumn("obs_date", F.col("obs_date").cast("string"))


@query("e03_group_folds", """WITH RECURSIVE o AS MATERIALIZED (SELECT platform, rows, row_number() OVER (ORDER BY rows DESC, platform) AS t FROM (SELECT platform, count(*) AS rows FROM fx_casts GROUP BY 1) g),
  st AS (SELECT 0::BIGINT AS t, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS fold UNION ALL
    SELECT t, list_transform(loads, lambda x, i: CASE WHEN i = p THEN x + rows ELSE x END), p FROM (SELECT o.t, o.rows, st.loads, list_position(st.loads, list_min(st.loads))::INT AS p FROM st JOIN o ON o.t = st.t + 1) n)
  SELECT platform, rows, fold FROM o JOIN st USING (t)""")
def _(v):
    return splits.group_folds(v.casts, "platform")


@query("e04_leave_one_event_out", """WITH c AS (SELECT event, count(*) AS n FROM fx_casts GROUP BY event) SELECT event AS held_out, n AS test_rows, (SELECT sum(n) FROM c)::BIGINT - n AS train_rows,
  (SELECT string_agg(d.event, ',' ORDER BY d.event) FROM c d WHERE d.event <> c.event) AS train_events FROM c""")
def _(v):
    return splits.leave_one_event_out(v.casts, "event")


# A ridge on two features, as SQL can solve it; fitted on some rows, scored on others.
@query("e04_event_errors", f"""WITH tr AS (SELECT event, o, p, o - p AS d, mlt_m, ssh_m FROM {PAIRS} t), s AS (SELECT e.event, {ridge_sql("mlt_m", "d", "ssh_m", 1)} FROM tr JOIN (SELECT DISTINCT event FROM tr) e ON tr.event <> e.event GROUP BY e.event)
  SELECT tr.event AS held_out, count(*) AS rows, avg(abs(p - o)) AS raw_mae, avg(abs(p + my1 + bx1*(mlt_m - mx1) + bz1*(ssh_m - mz1) - o)) AS mae, avg(p + my1 + bx1*(mlt_m - mx1) + bz1*(ssh_m - mz1) - o) AS bias
  FROM tr JOIN s ON tr.event = s.event GROUP BY tr.event""", "raw_mae mae bias")
def _(v):
    return ridge.leave_one_event_out(v.casts, "event", ["mlt_m", "ssh_m"], obs="obs_tchp", base="model_tchp")


HOLDOUT = f"""SELECT t.*, p + my1 + bx1*(mlt_m - mx1) + bz1*(ssh_m - mz1) AS c2 FROM {PAIRS} t, (SELECT {ridge_sql("mlt_m", "o - p", "ssh_m", 1)} FROM {PAIRS} t WHERE year BETWEEN 1995 AND 1997) s WHERE year = 1998"""


@query("e05_year_holdout", f"WITH h AS ({HOLDOUT}) " + " UNION ALL ".join(
    f"SELECT '{model}' AS model, '{kind}' AS subset_kind, {expr} AS subset, {METRICS_SQL} FROM (SELECT * EXCLUDE (p), {c} AS p FROM h) t GROUP BY ALL"
    for kind, expr in (("all", "'all'"), ("season", SEASON), ("region", REGION5)) for model, c in (("raw", "p"), ("ridge", "c2"))), METRIC_NUMBERS)
def _(v):
    """Fitted on three years, held out on the next: all rows, by season and by region."""
    years = lambda *y: F.col("year").isin(*y)
    scored = ridge.held_out(labelled(v).withColumn("all", F.lit("all")), {"holdout": (years(1995, 1996, 1997), years(1998))}, ["mlt_m", "ssh_m"], obs="obs_tchp", base="model_tchp",
                            keep=["obs_date", "season", "region", "all"])
    long = metrics.predictions_long(scored, ["obs_tchp", "obs_date", "season", "region", "all"], {"raw": "model_tchp", "ridge": "pred"})
    return metrics.grouped_metrics(long, ["all", "season", "region"], obs="obs_tchp", date="obs_date")


@query("w08_date_ordinals", "SELECT strftime(obs_date, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY obs_date) - 1 AS ordinal FROM (SELECT DISTINCT obs_date FROM fx_casts) t")
def _(v):
    return splits.date_ordinals(v.casts, "obs_date").select(F.col("obs_date").cast("string").alias("day"), F.col("ordinal").cast("long").alias("ordinal"))


@query("w09_average_ranks", "SELECT cast_id, rank() OVER (ORDER BY mlt_m) + (count(*) OVER (PARTITION BY mlt_m) - 1)/2.0 AS avg_rank FROM fx_casts", "avg_rank")
def _(v):
    from ..operators.ordered import average_ranks
    return average_ranks(v.casts.select("cast_id", "mlt_m"), "mlt_m", "avg_rank").select("cast_id", "avg_rank")


@query("w01_top_per_group", """SELECT platform, cast_id, rank FROM (SELECT platform, cast_id, row_number() OVER (PARTITION BY platform ORDER BY obs_tchp DESC NULLS LAST, cast_id) AS rank FROM fx_casts) t WHERE rank <= 2""")
def _(v):
    from ..operators.filters import top_per_group
    rows = top_per_group(v.casts, ["platform"], 2, F.desc_nulls_last("obs_tchp"), F.asc("cast_id"))
    return rows.select("platform", "cast_id", F.col("rank").cast("long").alias("rank"))
