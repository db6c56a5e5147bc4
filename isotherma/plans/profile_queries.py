"""Profile operators (A) on whole level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as prof
from .registry import query

# Heat above the isotherm by window functions, shared by the checks below. {rho} and {cp} are SQL expressions.
HEAT_SQL = """
l AS (SELECT cast_id, depth_m AS z, temp_c AS t, greatest(temp_c - 26.0, 0.0)*{rho}*{cp} AS h,
    lag(depth_m) OVER w AS z0, lag(temp_c) OVER w AS t0, lag(greatest(temp_c - 26.0, 0.0)*{rho}*{cp}) OVER w AS h0
  FROM fx_levels WINDOW w AS (PARTITION BY cast_id ORDER BY depth_m)),
a AS (SELECT cast_id, min_by(t, z) AS sst, max(z) AS zmax, count(*) AS n,
    min(CASE WHEN z0 IS NOT NULL AND t <= 26 THEN z END) AS zc FROM l GROUP BY cast_id),
d AS (SELECT cast_id, sst, zmax, n, zc, (SELECT CASE WHEN a.n >= 2 AND a.sst >= 26 THEN CASE WHEN l.t0 = l.t THEN l.z
    ELSE l.z0 + (l.t0 - 26.0)/(l.t0 - l.t)*(l.z - l.z0) END END FROM l WHERE l.cast_id = a.cast_id AND l.z = a.zc) AS d26 FROM a),
heat AS (SELECT d.cast_id, d.d26 AS d26_m, CASE WHEN d.n >= 2 THEN d.sst END AS surface_temp_c, d.zmax AS max_depth_m, d.n AS n_levels,
    CASE WHEN d.d26 IS NOT NULL THEN (SELECT coalesce(sum(CASE WHEN l.z0 IS NULL THEN 0 WHEN l.z < d.d26 THEN (l.h0 + l.h)/2*(l.z - l.z0)
      WHEN l.z0 < d.d26 THEN l.h0/2*(d.d26 - l.z0) ELSE 0 END), 0) FROM l WHERE l.cast_id = d.cast_id AND l.z <= d.zc)/1e7 END AS tchp_kj_per_cm2,
    CASE WHEN d.d26 IS NULL THEN 0 ELSE (SELECT count(*) FROM l WHERE l.cast_id = d.cast_id AND l.z < d.d26) END AS levels_above FROM d)
"""
CONSTANT = HEAT_SQL.format(rho="1026.0", cp="4180.0")
HEAT_COLUMNS = "d26_m tchp_kj_per_cm2 surface_temp_c"
HEAT_SELECT = "SELECT cast_id, d26_m, tchp_kj_per_cm2, surface_temp_c, max_depth_m, n_levels, levels_above FROM heat"
HEAT_LIST = ["cast_id", "d26_m", "tchp_kj_per_cm2", "surface_temp_c", "max_depth_m", "n_levels", "levels_above"]
LAGGED = """l AS (SELECT cast_id, k, depth_m AS z, temp_c AS t, salinity_psu AS s, sigma0 AS g, lag(depth_m) OVER w AS z0, lag(temp_c) OVER w AS t0,
  lag(sigma0) OVER w AS g0, first_value(temp_c) OVER w AS tf, first_value(sigma0) OVER w AS gf FROM fx_levels
  WINDOW w AS (PARTITION BY cast_id ORDER BY depth_m))"""


@query("a01_clean_profile", "SELECT cast_id, depth_m, temp_c FROM fx_levels WHERE temp_c IS NOT NULL AND depth_m IS NOT NULL", "temp_c")
def _(v):
    return prof.clean_profile(v.levels, ["depth_m", "temp_c"]).select("cast_id", "depth_m", "temp_c")


@query("a02_isotherm_depth", f"WITH {CONSTANT} SELECT cast_id, d26_m FROM heat", "d26_m")
def _(v):
    return prof.isotherm_depth(v.levels)


@query("a03_heat_excess_trapezoid", f"WITH {CONSTANT} {HEAT_SELECT}", HEAT_COLUMNS)
def _(v):
    return prof.heat_excess_trapezoid(v.levels).select(*HEAT_LIST)


@query("a04_heat_excess_variable_density", f"WITH {HEAT_SQL.format(rho='rho', cp='cp')} {HEAT_SELECT}", HEAT_COLUMNS)
def _(v):
    return prof.heat_excess_trapezoid(v.levels, rho="rho", cp="cp").select(*HEAT_LIST)


LAYER_ROWS = "CASE WHEN (cast_id + k) % 9 = 0 THEN -1.0 ELSE 9806.0*CAST(3 + k % 5 AS DOUBLE) END"


@query("a05_heat_excess_layers", f"""WITH r AS (SELECT cast_id, k, temp_c AS t, {LAYER_ROWS} AS thk FROM fx_levels),
  v AS (SELECT *, CAST(thk > 0 AS INT) AS ok, CASE WHEN thk > 0 THEN thk/9806.0 ELSE 0 END AS dz FROM r),
  c AS (SELECT *, sum(dz) OVER (PARTITION BY cast_id ORDER BY k) AS bot, row_number() OVER (PARTITION BY cast_id ORDER BY k) AS rn FROM v),
  g AS (SELECT *, bot - dz AS top, bot - dz/2 AS mid, lag(t) OVER w AS t0, lag(bot - dz/2) OVER w AS mid0 FROM c WINDOW w AS (PARTITION BY cast_id ORDER BY k)),
  f AS (SELECT cast_id, bool_or(rn = 1 AND ok = 1 AND t >= 26) AS warm, max(CASE WHEN rn = 1 AND ok = 1 THEN t END) AS sst,
    min(CASE WHEN ok = 1 AND t <= 26 THEN k END) AS kc FROM g GROUP BY cast_id),
  d AS (SELECT f.cast_id, f.sst, CASE WHEN f.warm AND g.t0 <> g.t THEN g.mid0 + (g.t0 - 26.0)/(g.t0 - g.t)*(g.mid - g.mid0) END AS d26
    FROM f LEFT JOIN g ON g.cast_id = f.cast_id AND g.k = f.kc)
  SELECT d.cast_id, any_value(d.d26) AS d26_m, any_value(d.sst) AS surface_temp_c, CASE WHEN any_value(d.d26) IS NOT NULL THEN sum(CASE WHEN g.ok = 0 THEN 0
    WHEN g.bot <= d.d26 THEN g.dz WHEN g.top < d.d26 AND g.bot > d.d26 THEN d.d26 - g.top ELSE 0 END * greatest(g.t - 26.0, 0)*1026.0*4180.0)/1e7 END AS tchp_kj_per_cm2
  FROM d JOIN g USING (cast_id) GROUP BY d.cast_id""", HEAT_COLUMNS)
def _(v):
    rows = v.levels.withColumn("thk_pa", F.expr(LAYER_ROWS).cast("double"))
    return prof.heat_excess_layers(rows).select("cast_id", "d26_m", "surface_temp_c", "tchp_kj_per_cm2")


@query("a06_heat_excess_zlevels", """WITH r AS (SELECT cast_id, depth_m AS z, temp_c AS t, row_number() OVER w AS rn, lag(depth_m) OVER w AS z0, lag(temp_c) OVER w AS t0,
    lead(depth_m) OVER w AS z1 FROM fx_levels WHERE depth_m <= 1000 WINDOW w AS (PARTITION BY cast_id ORDER BY depth_m)),
  g AS (SELECT *, CASE WHEN z0 IS NULL THEN 0 ELSE (z0 + z)/2 END AS top, CASE WHEN z1 IS NULL THEN z ELSE (z + z1)/2 END AS bot FROM r),
  f AS (SELECT cast_id, bool_or(rn = 1 AND t >= 26) AS warm, max(CASE WHEN rn = 1 THEN t END) AS sst, min(CASE WHEN t <= 26 THEN z END) AS zc FROM g GROUP BY cast_id),
  d AS (SELECT f.cast_id, f.sst, CASE WHEN f.warm AND g.t0 <> g.t THEN g.z0 + (g.t0 - 26.0)/(g.t0 - g.t)*(g.z - g.z0) END AS d26
    FROM f LEFT JOIN g ON g.cast_id = f.cast_id AND g.z = f.zc)
  SELECT d.cast_id, any_value(d.d26) AS d26_m, any_value(d.sst) AS surface_temp_c, CASE WHEN any_value(d.d26) IS NOT NULL THEN sum(CASE
    WHEN g.bot <= d.d26 THEN g.bot - g.top WHEN g.top < d.d26 AND g.bot > d.d26 THEN d.d26 - g.top ELSE 0 END * greatest(g.t - 26.0, 0)*1026.0*4180.0)/1e7 END AS tchp_kj_per_cm2
  FROM d JOIN g USING (cast_id) GROUP BY d.cast_id""", HEAT_COLUMNS)
def _(v):
    return prof.heat_excess_zlevels(v.levels, max_depth=1000.0).select("cast_id", "d26_m", "surface_temp_c", "tchp_kj_per_cm2")


def crossing_sql(v: str, threshold: str, op: str) -> str:
    v0 = f"{v}0"
    return (f"min_by(CASE WHEN z0 IS NULL OR {v0} = {v} THEN z ELSE z0 + ({threshold} - {v0})/({v} - {v0})*(z - z0) END, z)"
            f" FILTER (WHERE {v} {op} {threshold})")


@query("a07_first_crossing_depth", f"WITH {LAGGED} SELECT cast_id, {crossing_sql('t', '24.5', '<=')} AS crossing_m FROM l GROUP BY cast_id", "crossing_m")
def _(v):
    return prof.first_crossing_depth(v.levels, 24.5, increasing=False)


@query("a08_layer_depths", f"""WITH {LAGGED}, b AS (SELECT cast_id, {crossing_sql('g', '(gf + 0.125)', '>=')} AS mld_sigma_m,
  {crossing_sql('t', '(tf - 0.5)', '<=')} AS ild_m, {crossing_sql('t', '(tf - 0.2)', '<=')} AS ild_dt02_m FROM l GROUP BY cast_id HAVING count(*) >= 5)
  SELECT *, CASE WHEN ild_m IS NOT NULL AND mld_sigma_m IS NOT NULL THEN greatest(ild_m - mld_sigma_m, 0.0) END AS barrier_layer_thickness_m,
  CASE WHEN ild_dt02_m IS NOT NULL AND mld_sigma_m IS NOT NULL THEN greatest(ild_dt02_m - mld_sigma_m, 0.0) END AS blt_dt02_m FROM b""",
       "mld_sigma_m ild_m ild_dt02_m barrier_layer_thickness_m blt_dt02_m")
def _(v):
    return prof.layer_depths(v.levels)


@query("a09_stratification_summary", """WITH n AS (SELECT cast_id, depth_m AS z, sigma0 - 20.0 AS n2 FROM fx_levels),
  d AS (SELECT cast_id, obs_d26 AS d26, mlt_m AS mld FROM fx_casts_as_key) SELECT n.cast_id, avg(CASE WHEN z <= 200 THEN n2 END) AS n2_mean_upper200,
  max(CASE WHEN z <= 200 THEN n2 END) AS n2_max_upper200, avg(CASE WHEN z <= d26 THEN n2 END) AS n2_mean_to_d26, max(CASE WHEN z <= d26 THEN n2 END) AS n2_max_to_d26,
  max(CASE WHEN abs(z - mld) <= 20 THEN n2 END) AS n2_max_near_mld, max(CASE WHEN z <= mld - 20 THEN n2 END) AS n2_max_above_mld
  FROM n LEFT JOIN d USING (cast_id) GROUP BY n.cast_id""".replace("fx_casts_as_key", "fx_casts"),
       "n2_mean_upper200 n2_max_upper200 n2_mean_to_d26 n2_max_to_d26 n2_max_near_mld n2_max_above_mld")
def _(v):
    n2 = v.levels.select("cast_id", "depth_m", (F.col("sigma0") - 20.0).alias("n2"))
    depths = v.casts.select("cast_id", F.col("obs_d26").alias("d26_m"), F.col("mlt_m").alias("mld_sigma_m"))
    return prof.stratification_summary(n2, depths)


@query("a10_property_at_depth", """WITH j AS (SELECT l.cast_id, l.depth_m AS z, l.salinity_psu AS s, c.mlt_m*3.0 AS zs FROM fx_levels l JOIN fx_casts c USING (cast_id)),
  b AS (SELECT cast_id, zs AS z_star, max(CASE WHEN z <= zs THEN z END) AS z0, min(CASE WHEN z >= zs THEN z END) AS z1, max_by(s, z) FILTER (WHERE z <= zs) AS s0,
    min_by(s, z) FILTER (WHERE z >= zs) AS s1 FROM j GROUP BY cast_id, zs)
  SELECT cast_id, z_star, CASE WHEN z0 IS NULL THEN s1 WHEN z1 IS NULL OR z1 = z0 THEN s0 ELSE s0 + (s1 - s0)*(z_star - z0)/(z1 - z0) END AS value_at_depth FROM b""",
       "value_at_depth")
def _(v):
    return prof.property_at_depth(v.levels, v.casts.select("cast_id", (F.col("mlt_m") * 3.0).alias("z_star")))


@query("a11_integral_to_reference", """WITH l AS (SELECT cast_id, depth_m AS p, 1.0e-5*(28.0 - sigma0) AS a, lag(depth_m) OVER w AS p0, lag(1.0e-5*(28.0 - sigma0)) OVER w AS a0
    FROM fx_levels WINDOW w AS (PARTITION BY cast_id ORDER BY depth_m)),
  r AS (SELECT cast_id, count(*) AS n, max(p) AS pm, sum(CASE WHEN p0 < 60 THEN (a0 + a0 + (a - a0)*(least(p, 60.0) - p0)/(p - p0))/2*(least(p, 60.0) - p0) END) AS i1,
    sum(CASE WHEN p0 < 120 THEN (a0 + a0 + (a - a0)*(least(p, 120.0) - p0)/(p - p0))/2*(least(p, 120.0) - p0) END) AS i2 FROM l GROUP BY cast_id),
  s AS (SELECT cast_id, CASE WHEN n >= 5 AND pm >= 60 THEN i1*1e4/9.81 END AS steric_0_60_m, CASE WHEN n >= 5 AND pm >= 120 THEN i2*1e4/9.81 END AS steric_0_120_m FROM r)
  SELECT *, steric_0_120_m - steric_0_60_m AS steric_60_ref120_m FROM s""", "steric_0_60_m steric_0_120_m steric_60_ref120_m")
def _(v):
    rows = v.levels.select("cast_id", "depth_m", (1.0e-5 * (28.0 - F.col("sigma0"))).alias("sva"))
    return prof.integral_to_reference(rows, [60.0, 120.0])


@query("a12_dedupe_levels", f"""WITH {LAGGED}, kept AS (SELECT cast_id, z, t FROM l WHERE z0 IS NULL OR z - z0 > 5.0)
  SELECT cast_id, z AS depth_m, t AS temp_c FROM kept WHERE cast_id IN (SELECT cast_id FROM kept GROUP BY cast_id HAVING count(*) >= 3)""", "temp_c")
def _(v):
    return prof.dedupe_levels(v.levels, eps=5.0, min_levels=3)


@query("a13_inversion_bands", f"""WITH {LAGGED}, w AS (SELECT *, CAST(coalesce(t > t0, false) AS INT) AS up FROM l),
  i AS (SELECT *, sum(1 - up) OVER (PARTITION BY cast_id ORDER BY z) AS island FROM w)
  SELECT cast_id, min(z0) AS z_top, max(z) AS z_bottom, max_by(t, z) - min_by(t0, z) AS dt, max_by(g, z) - min_by(g0, z) AS dsigma,
    CAST(max_by(g, z) - min_by(g0, z) < 0 AS INT) AS unstable FROM i WHERE up = 1 GROUP BY cast_id, island HAVING max_by(t, z) - min_by(t0, z) >= 0.05""", "dt dsigma")
def _(v):
    return prof.inversion_bands(v.levels)


@query("a14_rescale_profile", """SELECT l.cast_id, l.k, CASE WHEN temp_c >= 26 THEN 26.0 + (temp_c - 26.0)*greatest(0.0, coalesce(greatest(0.0, c.corrected_tchp)/nullif(c.model_tchp, 0), 0.0))
  ELSE temp_c END AS corrected_temp_c FROM fx_levels l JOIN fx_casts c USING (cast_id) WHERE c.model_tchp IS NOT NULL""", "corrected_temp_c")
def _(v):
    scalars = v.casts.where("model_tchp IS NOT NULL").select("cast_id", F.col("model_tchp").alias("raw_tchp"), "corrected_tchp")
    return prof.rescale_profile(v.levels, scalars).select("cast_id", "k", "corrected_temp_c")


@query("a15_profile_summary", """SELECT cast_id, count(*) AS n_levels, max(depth_m) AS max_depth_m, min(depth_m) AS min_depth_m, min_by(temp_c, depth_m) AS surface_t_c,
  min_by(salinity_psu, depth_m) AS surface_s_psu FROM fx_levels GROUP BY cast_id""", "surface_t_c surface_s_psu")
def _(v):
    return prof.profile_summary(v.levels)
