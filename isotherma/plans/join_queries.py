"""Joins (J), grids and the flagship query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import grids, joins, metrics, profiles, spatial
from ..session import shared_folder
from ..sources import writers
from .profile_queries import CONSTANT
from .registry import hav, query
from .scalar_queries import REGION5, SEASON

DAY = "CAST(dt AS STRING) AS dt"
KNN_SQL = f"""
pos AS (SELECT DISTINCT lat, lon FROM {{obs}}),
knn AS (SELECT * FROM (SELECT pos.lat, pos.lon, g.y, g.x, {hav('pos.lon', 'pos.lat', 'g.lon', 'g.lat')} AS km,
    row_number() OVER (PARTITION BY pos.lat, pos.lon ORDER BY {hav('pos.lon', 'pos.lat', 'g.lon', 'g.lat')}, g.y, g.x) AS rank
  FROM pos CROSS JOIN fx_geometry g) t WHERE rank <= {{k}})
"""


def idw_sql(value: str) -> str:
    return (f"coalesce(min_by({value}, km) FILTER (WHERE km <= 1e-6 AND {value} IS NOT NULL), sum({value}/pow(greatest(km, 1e-6), 2))"
            f"/sum(CASE WHEN {value} IS NOT NULL THEN 1/pow(greatest(km, 1e-6), 2) END))")


def seconds(c: str):
    """Seconds of a timestamp without time zone, as a double."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def nearest_sql(order: str, km: str) -> str:
    return f"""SELECT o.obs_id, strftime(o.dt, '%Y-%m-%d') AS dt, g.y, g.x, {km} AS distance_km FROM fx_obs o JOIN fx_grid g ON g.dt = o.dt AND g.sst_c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o.obs_id ORDER BY {order}, g.y, g.x) = 1"""


KM = hav("o.lon", "o.lat", "g.lon", "g.lat")


@query("j01_nearest_cell", nearest_sql(KM, KM), "distance_km")
def _(v):
    near = spatial.nearest_cell(v.obs, v.grid, obs_cols=["obs_id", "dt"])
    return near.selectExpr("obs_id", DAY, "y", "x", "distance_km")


@query("j01_nearest_cell_planar", nearest_sql("round((g.lat-o.lat)*(g.lat-o.lat) + (g.lon-o.lon)*(g.lon-o.lon), 9)", KM), "distance_km")
def _(v):
    near = spatial.nearest_cell(v.obs, v.grid, obs_cols=["obs_id", "dt"], metric="planar_deg")
    return near.selectExpr("obs_id", DAY, "y", "x", "distance_km")


@query("j02_knn_cells", f"""WITH {KNN_SQL.format(obs='fx_obs', k=8)} SELECT o.obs_id, k.y, k.x, k.km AS distance_km, k.rank FROM fx_obs o JOIN knn k USING (lat, lon)""",
       "distance_km")
def _(v):
    near = spatial.knn_cells(v.obs, v.geometry, 8, obs_cols=["obs_id"])
    return near.select("obs_id", "y", "x", "distance_km", F.col("rank").cast("long").alias("rank"))


@query("j03_idw_sample", f"""WITH {KNN_SQL.format(obs='fx_obs', k=8)} SELECT o.obs_id, {idw_sql('g.sst_c')} AS sst_c, {idw_sql('g.tchp')} AS tchp, min(km) AS nearest_km
  FROM fx_obs o JOIN knn k USING (lat, lon) JOIN fx_grid g ON g.dt = o.dt AND g.y = k.y AND g.x = k.x GROUP BY o.obs_id""", "sst_c tchp nearest_km")
def _(v):
    near = spatial.knn_cells(v.obs, v.geometry, 8, obs_cols=["obs_id", "dt"])
    return spatial.idw_sample(near, v.grid, ["sst_c", "tchp"], obs_cols=["obs_id"])


QUERY_POINTS = "SELECT cast_id AS query_id, lat, lon, dt + INTERVAL 12 HOUR AS at FROM fx_casts"


@query("j04_support_join", f"""WITH p AS (SELECT q.query_id, o.obs_id, {hav('q.lon', 'q.lat', 'o.lon', 'o.lat')} AS distance_km, abs(epoch_us(o.obs_time) - epoch_us(q.at))/3.6e9 AS gap_h
    FROM ({QUERY_POINTS}) q JOIN fx_obs o ON abs(o.lat - q.lat) <= 1.8 AND o.obs_time BETWEEN q.at - INTERVAL 72 HOUR AND q.at + INTERVAL 72 HOUR),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_km, gap_h, obs_id) AS rank FROM p WHERE distance_km <= 200)
  SELECT query_id, obs_id, distance_km, gap_h, rank FROM r WHERE rank <= 10""", "distance_km gap_h")
def _(v):
    q = v.casts.select(F.col("cast_id").alias("query_id"), "lat", "lon", (F.unix_date("dt") * 86400.0 + 43200.0).alias("ts"))
    near = spatial.support_join(q, v.obs.withColumn("ts", seconds("obs_time")), query_cols=["query_id"], obs_cols=["obs_id"], tie=["obs_id"])
    return near.select("query_id", "obs_id", "distance_km", "gap_h", F.col("rank").cast("long").alias("rank"))


SUPPORT_SQL = f"""
tr AS (SELECT cast_id, platform, lat, lon FROM fx_casts WHERE year <= 1998), te AS (SELECT * FROM fx_casts WHERE year >= 1999),
near AS (SELECT te.cast_id, min({hav('te.lon', 'te.lat', 'tr.lon', 'tr.lat')}) AS support_km FROM te CROSS JOIN tr GROUP BY te.cast_id)
"""


def support(v, same=()):
    train = v.casts.where("year <= 1998").select(F.col("cast_id").alias("train_id"), "platform", "lat", "lon")
    test = v.casts.where("year >= 1999").select("cast_id", "platform", "lat", "lon")
    return spatial.nearest_support_km(test, train, test_cols=["cast_id"], train_id="train_id", same=same)


@query("j05_nearest_support_km", f"WITH {SUPPORT_SQL} SELECT * FROM near", "support_km")
def _(v):
    return support(v)


@query("j05_same_platform_support_km", f"""SELECT te.cast_id, min({hav('te.lon', 'te.lat', 'tr.lon', 'tr.lat')}) AS support_km FROM fx_casts te
  JOIN fx_casts tr ON tr.platform = te.platform AND tr.year <= 1998 WHERE te.year >= 1999 GROUP BY te.cast_id""", "support_km")
def _(v):
    return support(v, ["platform"])


@query("j06_occurrence_join", """WITH a AS (SELECT obs_date, event, cast_id, obs_tchp, row_number() OVER (PARTITION BY obs_date, event ORDER BY cast_id) - 1 AS occurrence FROM fx_casts)
  SELECT cast_id, occurrence, obs_tchp FROM a""", "obs_tchp")
def _(v):
    left = v.casts.select("obs_date", "event", "cast_id")
    right = v.casts.select("obs_date", "event", F.col("cast_id").alias("row"), "obs_tchp")
    return joins.occurrence_join(left, right, ["obs_date", "event"], "cast_id", "row").select("cast_id", "occurrence", "obs_tchp")


@query("j07_align_tables", "SELECT cast_id, lat, ssh_m, mlt_m FROM fx_casts", "lat ssh_m mlt_m")
def _(v):
    base = v.casts.select("cast_id", "lat")
    return joins.align_tables(base, [v.casts.select("cast_id", "lat", "ssh_m"), v.casts.select("cast_id", "mlt_m")], "cast_id", []).select(
        "cast_id", "lat", "ssh_m", "mlt_m")


@query("j08_join_predictions", """SELECT cast_id, obs_tchp, obs_d26 FROM fx_casts WHERE obs_tchp IS NOT NULL AND obs_d26 IS NOT NULL""", "obs_tchp obs_d26")
def _(v):
    shared = ["cast_id", "obs_date", "lat", "lon"]
    a = v.casts.where("obs_tchp IS NOT NULL").select(*shared, "obs_tchp")
    return joins.join_predictions(a, v.casts.where("obs_d26 IS NOT NULL").select(*shared, "obs_d26"), shared).select("cast_id", "obs_tchp", "obs_d26")


@query("j09_restrict_to_dates", "SELECT cast_id FROM fx_casts WHERE dt IN (SELECT dt FROM fx_obs WHERE storm = 'error')")
def _(v):
    return joins.restrict_to_dates(v.casts.select("cast_id", "dt"), v.obs.where("storm = 'error'")).select("cast_id")


@query("j10_skip_done", "SELECT cast_id FROM fx_casts WHERE cast_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(v):
    done = v.table("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("cast_id"))
    return joins.skip_done(v.casts.select("cast_id"), done, "cast_id")


CELL_SQL = "CAST(least({n}, greatest(0, {f}(({c} - ({o})){plus}))) AS INT)"


@query("j11_climatology_difference", "WITH o AS (SELECT cast_id, month, " + CELL_SQL.format(n=179, f="ceil", c="lat", o=-89.5, plus="") + " AS ilat, "
       + CELL_SQL.format(n=359, f="floor", c="lon", o=-179.5, plus=" + 0.5") + """ AS ilon, model_tchp FROM (SELECT cast_id, month, lat, lon, model_tchp FROM fx_casts) t),
  c AS (SELECT month, ilat, ilon, avg(model_tchp) AS clim FROM o GROUP BY ALL)
  SELECT o.cast_id, o.ilat, o.ilon, c.clim, o.model_tchp - c.clim AS model_minus_clim FROM o JOIN c USING (month, ilat, ilon)""", "clim model_minus_clim")
def _(v):
    cells = v.casts.withColumn("ilat", joins.climatology_cell("lat", -89.5, "ceil", n=180)).withColumn(
        "ilon", joins.climatology_cell("lon", -179.5, "nearest", n=360))
    clim = cells.groupBy("month", "ilat", "ilon").agg(F.avg("model_tchp").alias("clim"))
    rows = cells.join(clim, ["month", "ilat", "ilon"])
    return rows.select("cast_id", "ilat", "ilon", "clim", fn.model_minus_climatology("model_tchp", "clim").alias("model_minus_clim"))


def wide_window_sql(h: int, name: str) -> str:
    """Sums along the rows of the grid at every column, then over the rows of each observation's window."""
    along = ", ".join(f"count(k.{f}) AS n_{f}, sum(k.{f}) AS s_{f}, sum(k.{f}*k.{f}) AS q_{f}" for f in FIELDS)
    stats = ", ".join(f"CASE WHEN sum(n_{f}) >= 0.25*cells THEN sum(s_{f})/sum(n_{f}) END AS {f}_mean_{name}, "
                      f"CASE WHEN sum(n_{f}) >= 0.25*cells THEN sqrt(greatest(sum(q_{f})/sum(n_{f}) - pow(sum(s_{f})/sum(n_{f}), 2), 0)) END AS {f}_std_{name}" for f in FIELDS)
    return f"""r{name} AS MATERIALIZED (SELECT d.dt, d.y, d.x, {along} FROM d CROSS JOIN range(-{h}, {h + 1}) a(dx) JOIN g k ON k.dt = d.dt AND k.y = d.y AND k.x = (d.x + a.dx + 100*d.nx) % d.nx GROUP BY ALL),
  w{name} AS MATERIALIZED (SELECT obs_id, {stats} FROM (SELECT c.obs_id, (least(c.y + {h}, c.ny - 1) - greatest(c.y - {h}, 0) + 1)*{2 * h + 1} AS cells, r.*
  FROM c CROSS JOIN range(-{h}, {h + 1}) b(dy) JOIN r{name} r ON r.dt = c.dt AND r.y = c.y + b.dy AND r.x = c.x) t GROUP BY obs_id, cells)"""


# The reference's half-widths, on three fields.
FIELDS = ["sst_c", "tchp", "d26"]
WIDE_COLUMNS = [f"{f}_{s}_{n}" for f in FIELDS for n in grids.HALF_WIDTHS for s in ("mean", "std")]


@query("j12_neighbourhood_wide", f"""WITH g AS MATERIALIZED (SELECT dt, y, x, nx, ny, {', '.join(FIELDS)} FROM fx_grid), {KNN_SQL.format(obs='fx_obs', k=1)}, c AS MATERIALIZED (SELECT o.obs_id, o.dt, k.y, k.x, g.nx, g.ny,
    {', '.join(f'g.{f}' for f in FIELDS)} FROM fx_obs o JOIN knn k USING (lat, lon) JOIN g ON g.dt = o.dt AND g.y = k.y AND g.x = k.x),
  d AS MATERIALIZED (SELECT dt, y, nx, unnest(range(nx))::INT AS x FROM (SELECT DISTINCT dt, y, nx FROM g) e), {', '.join(wide_window_sql(h, n) for n, h in grids.HALF_WIDTHS.items())}
  SELECT c.obs_id, {', '.join(WIDE_COLUMNS)}, {', '.join(f'c.{f} - {f}_mean_1deg AS {f}_anomaly' for f in FIELDS)} FROM c {' '.join(f'JOIN w{n} USING (obs_id)' for n in grids.HALF_WIDTHS)}""",
       " ".join([*WIDE_COLUMNS, *[f"{f}_anomaly" for f in FIELDS]]))
def _(v):
    cells = spatial.knn_cells(v.obs, v.geometry, 1, obs_cols=["obs_id", "dt"])
    return grids.neighbourhood(cells, v.grid, FIELDS, obs_cols=["obs_id"], nx=F.col("nx"), ny=F.col("ny"))


@query("j13_gradient_per_100km", """WITH g AS (SELECT * FROM fx_grid), n AS (SELECT g.dt, g.y, g.x, g.lat, g.ny, a.sst_c AS vs, a.lat AS las, b.sst_c AS vn, b.lat AS lan, c.sst_c AS vw, c.lon AS low,
    d.sst_c AS ve, d.lon AS loe, greatest(least(g.y+1, g.ny-1) - greatest(g.y-1, 0), 1) AS span FROM g
    LEFT JOIN g a ON a.dt = g.dt AND a.x = g.x AND a.y = greatest(g.y-1, 0) LEFT JOIN g b ON b.dt = g.dt AND b.x = g.x AND b.y = least(g.y+1, g.ny-1)
    LEFT JOIN g c ON c.dt = g.dt AND c.y = g.y AND c.x = (g.x-1+g.nx) % g.nx LEFT JOIN g d ON d.dt = g.dt AND d.y = g.y AND d.x = (g.x+1) % g.nx),
  s AS (SELECT *, greatest(abs((lan-las)/span)*111.19, 1e-3) AS dy, greatest(abs((((loe-low+540.0) % 360.0) - 180.0)/2)*111.19*greatest(cos(radians(lat)), 0.05), 1e-3) AS dx FROM n)
  SELECT strftime(dt, '%Y-%m-%d') AS dt, y, x, sqrt(pow((vn-vs)/(span*dy), 2) + pow((ve-vw)/(2*dx), 2))*100.0 AS grad_per_100km FROM s""", "grad_per_100km")
def _(v):
    return grids.gradient_per_100km(v.grid, "sst_c", nx=F.col("nx"), ny=F.col("ny")).selectExpr(DAY, "y", "x", "grad_per_100km")


MODEL_LEVELS = "fx_model AS (SELECT cast_id, k, depth_m, temp_c + (k % 5 - 2)*0.3 AS temp_c FROM fx_levels)"
PROFILE_SQL = f"""WITH {MODEL_LEVELS}, o AS (WITH {CONSTANT} SELECT * FROM heat), m AS (WITH {CONSTANT.replace('fx_levels', 'fx_model')} SELECT * FROM heat),
  p AS (SELECT cast_id, CAST(platform AS BIGINT) AS platform, corrected_tchp - model_tchp AS delta FROM fx_casts WHERE obs_tchp IS NOT NULL),
  s AS (SELECT p.cast_id, p.platform, o.tchp_kj_per_cm2 AS obs_tchp_kj_cm2, o.d26_m AS obs_d26_m, o.surface_temp_c AS obs_surface_t_c, m.tchp_kj_per_cm2 AS model_tchp_kj_cm2, m.d26_m AS model_d26_m,
    m.surface_temp_c AS model_surface_t_c, CASE WHEN m.tchp_kj_per_cm2 IS NOT NULL THEN delta END AS correction_delta_kj_cm2, CASE WHEN delta IS NULL OR m.tchp_kj_per_cm2 IS NULL THEN 'raw' ELSE 'ml_correction' END AS correction_source,
    CASE WHEN delta IS NULL THEN m.tchp_kj_per_cm2 WHEN m.tchp_kj_per_cm2 IS NOT NULL THEN greatest(0.0, m.tchp_kj_per_cm2 + delta) END AS corrected_tchp_kj_cm2,
    o.tchp_kj_per_cm2 - m.tchp_kj_per_cm2 AS delta_tchp_kj_cm2 FROM p LEFT JOIN o USING (cast_id) LEFT JOIN m USING (cast_id))"""


def profile_store(v):
    """Observed and modelled levels and the scalars of all casts with an observation, bucketed by cast."""
    name = uuid.uuid4().hex
    keep = lambda df, what: writers.write_bucketed(df, f"{what}_{name}", f"{shared_folder(v.spark)}/{what}-{name}", "cast_id")
    observed = keep(v.levels.select("cast_id", "k", "depth_m", "temp_c"), "observed")
    model = keep(observed.withColumn("temp_c", F.col("temp_c") + (F.col("k") % 5 - 2) * 0.3), "modelled")
    pairs = v.casts.where("obs_tchp IS NOT NULL").select("cast_id", F.col("platform").cast("long").alias("platform"), (F.col("corrected_tchp") - F.col("model_tchp")).alias("predicted_delta"))
    return keep(joins.profile_scalars(pairs, observed, model), "scalars"), observed, model


@query("j14_profile_scalars", f"{PROFILE_SQL} SELECT * FROM s", "obs_tchp_kj_cm2 obs_d26_m obs_surface_t_c model_tchp_kj_cm2 model_d26_m model_surface_t_c correction_delta_kj_cm2 corrected_tchp_kj_cm2 delta_tchp_kj_cm2")
def _(v):
    return profile_store(v)[0]


@query("j14_profile_lookup", f"""{PROFILE_SQL} SELECT s.cast_id, l.k, l.depth_m, 'observed' AS profile, l.temp_c FROM s JOIN fx_levels l USING (cast_id) UNION ALL
  SELECT s.cast_id, l.k, l.depth_m, 'model', l.temp_c FROM s JOIN fx_model l USING (cast_id) UNION ALL
  SELECT s.cast_id, l.k, l.depth_m, 'corrected', CASE WHEN correction_source <> 'raw' AND model_tchp_kj_cm2 > 0 AND l.temp_c >= 26 THEN 26 + (l.temp_c - 26)*corrected_tchp_kj_cm2/model_tchp_kj_cm2 ELSE l.temp_c END
  FROM s JOIN fx_model l USING (cast_id)""", "depth_m temp_c")
def _(v):
    return joins.profile_lookup(*profile_store(v), keep=["k"])


@query("j15_pick_cast", """SELECT cast_id, 'nearest' AS rule FROM (SELECT cast_id FROM fx_casts WHERE dt = DATE '2024-01-15'
  ORDER BY (lat-24.0)*(lat-24.0) + (lon+87.5)*(lon+87.5), cast_id LIMIT 1) a UNION ALL SELECT cast_id, 'largest' FROM (SELECT cast_id FROM fx_casts
  WHERE obs_tchp - model_tchp > 0 ORDER BY obs_tchp - model_tchp DESC, cast_id LIMIT 1) b""")
def _(v):
    near = joins.pick_cast(v.casts, "dt", F.lit("2024-01-15").cast("date"), 24.0, -87.5).select("cast_id", F.lit("nearest").alias("rule"))
    pairs = v.casts.withColumn("delta", F.col("obs_tchp") - F.col("model_tchp"))
    return near.unionByName(joins.pick_largest_delta(pairs, "delta").select("cast_id", F.lit("largest").alias("rule")))


STORM = "SELECT obs_id, dt, lat, lon, obs_time FROM fx_obs WHERE storm = 'error' AND lat BETWEEN 5 AND 30 AND lon BETWEEN -100 AND -20"


@query("j16_pair_event", f"""WITH {CONSTANT}, tr AS ({STORM}), b AS (SELECT min(lat)-5 AS s, max(lat)+5 AS n, min(lon)-5 AS w, max(lon)+5 AS e FROM tr),
  gate AS (SELECT cast_id FROM fx_levels GROUP BY cast_id HAVING count(*) >= 3 AND max(depth_m) >= 100),
  c AS (SELECT c.* FROM fx_casts c, b WHERE c.dt IN (SELECT dt FROM tr) AND c.lat BETWEEN b.s AND b.n AND c.lon BETWEEN b.w AND b.e AND c.cast_id IN (SELECT cast_id FROM gate)),
  nr AS (SELECT o.cast_id, o.dt, g.y, g.x, g.tchp, {KM} AS km FROM c o JOIN fx_grid g ON g.dt = o.dt AND g.sst_c IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY o.cast_id ORDER BY round((g.lat-o.lat)*(g.lat-o.lat) + (g.lon-o.lon)*(g.lon-o.lon), 9), g.y, g.x) = 1)
  SELECT nr.cast_id, strftime(nr.dt, '%Y-%m-%d') AS dt, nr.y, nr.x, km AS model_grid_distance_km, heat.d26_m AS obs_d26_m, heat.tchp_kj_per_cm2 AS obs_tchp_kj_cm2,
    nr.tchp AS model_tchp_kj_cm2, heat.tchp_kj_per_cm2 - nr.tchp AS tchp_delta_kj_cm2 FROM nr JOIN heat USING (cast_id)""",
       "model_grid_distance_km obs_d26_m obs_tchp_kj_cm2 model_tchp_kj_cm2 tchp_delta_kj_cm2")
def _(v):
    track = v.obs.where("storm = 'error'").where(F.col("lat").between(5, 30) & F.col("lon").between(-100, -20)).withColumnRenamed("obs_time", "iso_time")
    out = joins.pair_event(track, v.casts, v.levels, v.grid, gate={"min_levels": 3, "min_depth": 100.0})
    return out.withColumn("dt", F.col("dt").cast("string"))


def gaussian_sql(value: str, length: float, radius: float, source: str = "fx_obs") -> str:
    return f"""(SELECT g.y, g.x, sum(exp(-pow(km/{length}, 2))*v)/sum(exp(-pow(km/{length}, 2))) AS {value}, count(*) AS n_obs, min(km) AS nearest_km FROM (SELECT g.y, g.x,
    {hav('g.lon', 'g.lat', 'o.lon', 'o.lat')} AS km, o.{value} AS v FROM fx_geometry g JOIN {source} o ON abs(o.lat - g.lat) <= {radius}/111.0 AND o.{value} IS NOT NULL) g
    WHERE km <= {radius} GROUP BY g.y, g.x)"""


@query("j17_gaussian_grid", f"""SELECT g.y, g.x, CASE WHEN w.nearest_km <= 200 THEN w.obs_value END AS obs_value, coalesce(w.n_obs, 0) AS n_obs, w.nearest_km
  FROM fx_geometry g LEFT JOIN {gaussian_sql('obs_value', 100.0, 300.0)} w USING (y, x)""", "obs_value nearest_km")
def _(v):
    return spatial.gaussian_grid(v.obs, v.geometry, "obs_value", cell_cols=["y", "x"], mask_km=200.0).select("y", "x", "obs_value", "n_obs", "nearest_km")


@query("j18_distance_mask", f"""WITH near AS (SELECT DISTINCT g.y, g.x FROM fx_geometry g JOIN fx_obs o ON abs(o.lat - g.lat) <= 1.0 WHERE {hav('g.lon', 'g.lat', 'o.lon', 'o.lat')} <= 100)
  SELECT g.y, g.x, CASE WHEN n.y IS NOT NULL THEN g.lat END AS value FROM fx_geometry g LEFT JOIN near n USING (y, x)""", "value")
def _(v):
    cells = v.geometry.withColumn("value", F.col("lat"))
    return spatial.distance_mask(cells, v.obs, "value", 100.0, cell_cols=["y", "x"]).select("y", "x", "value")


SEASONAL = """(SELECT g.y, g.x, season, sum(exp(-pow(km/150.0, 2))*{v})/sum(exp(-pow(km/150.0, 2))) AS {v} FROM (SELECT g.y, g.x, {season} AS season, {km} AS km, o.{v}
    FROM fx_geometry g JOIN fx_casts o ON abs(o.lat - g.lat) <= 450.0/111.0 AND o.{v} IS NOT NULL) g WHERE km <= 450.0 GROUP BY ALL)"""
seasonal = lambda v: SEASONAL.format(v=v, season=SEASON, km=hav("g.lon", "g.lat", "o.lon", "o.lat"))
SURFACE_STATS = """count(difference) AS cells, avg(difference) AS mean, stddev_samp(difference) AS std, avg(abs(difference)) AS mae, sqrt(avg(difference*difference)) AS rmse,
    min(difference) AS min, max(difference) AS max, quantile_cont(difference, 0.5) AS median"""


@query("j19_surface_difference", f"""SELECT season, {SURFACE_STATS} FROM (SELECT season, a.obs_tchp - b.model_tchp AS difference FROM {seasonal('obs_tchp')} a JOIN {seasonal('model_tchp')} b USING (y, x, season))
  GROUP BY season""", "mean std mae rmse min max median")
def _(v):
    """Both surfaces of all seasons from one pass."""
    casts = v.casts.withColumn("season", fn.season_label("month"))
    both = spatial.gaussian_fields(casts, v.geometry, ["obs_tchp", "model_tchp"], cell_cols=["y", "x"], by=["season"], length_km=150.0, radius_km=450.0)
    return grids.surface_statistics(grids.surface_change(both, "obs_tchp", "model_tchp"), ["season"])


@query("j20_attach_features", """SELECT c.cast_id, c.obs_tchp, f.n_casts FROM fx_casts c LEFT JOIN (SELECT platform, count(*) AS n_casts FROM fx_casts WHERE year < 2000 GROUP BY platform) f
  USING (platform)""", "obs_tchp")
def _(v):
    features = v.casts.where("year < 2000").groupBy("platform").agg(F.count(F.lit(1)).alias("n_casts"))
    return joins.attach_features(v.casts.select("cast_id", "platform", "obs_tchp"), features, ["platform"]).select("cast_id", "obs_tchp", "n_casts")


@query("a16_idw_profile", f"""WITH {KNN_SQL.format(obs='fx_obs', k=4)}, col AS (SELECT *, CAST(d AS INT) AS kz, 28.0 - 0.4*d - abs(lat)/10.0 AS t FROM (SELECT *, unnest(range(6)) AS d FROM fx_geometry) e)
  SELECT o.obs_id, col.kz AS k, {idw_sql('t')} AS t FROM fx_obs o JOIN knn k USING (lat, lon) JOIN col ON col.y = k.y AND col.x = k.x GROUP BY o.obs_id, col.kz""", "t")
def _(v):
    near = spatial.knn_cells(v.obs, v.geometry, 4, obs_cols=["obs_id"])
    columns = v.geometry.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "y", "x", "k", (28.0 - 0.4 * F.col("k") - F.abs("lat") / 10.0).alias("t"))
    return profiles.idw_profile(near, columns, ["obs_id"], ["y", "x"], ["t"])


def flagship(v):
    """Levels to observed heat, cells to modelled heat, error by region and season."""
    from ..operators.filters import qc_levels

    levels = qc_levels(v.levels, ["depth_m", "temp_c"], ["qc"])
    heat = profiles.heat_excess_trapezoid(levels).where("tchp_kj_per_cm2 IS NOT NULL").select("cast_id", F.col("tchp_kj_per_cm2").alias("obs"))
    casts = joins.restrict_to_dates(v.casts.select("cast_id", "dt", "lat", "lon", "month", "obs_date"), v.grid)
    near = spatial.knn_cells(casts, v.geometry, 8, obs_cols=["cast_id", "dt"])
    model = spatial.idw_sample(near, v.grid, ["tchp"], obs_cols=["cast_id"]).select("cast_id", F.col("tchp").alias("pred"))
    rows = casts.join(heat, "cast_id").join(model, "cast_id").select(
        "obs", "pred", F.col("obs_date").alias("date"), fn.region_5("lat", "lon").alias("region"), fn.season_label("month").alias("season"),
        F.lit("raw").alias("model"))
    return metrics.grouped_metrics(rows, ["region", "season"]).select("subset_kind", "subset", "rows", "dates", "mae", "rmse", "bias")


FLAGSHIP_SQL = f"""WITH {CONSTANT.replace('FROM fx_levels WINDOW', "FROM fx_levels WHERE qc IN ('1','2') WINDOW")}, {KNN_SQL.format(obs='fx_casts', k=8)},
  m AS (SELECT c.cast_id, {idw_sql('g.tchp')} AS pred FROM fx_casts c JOIN knn k USING (lat, lon) JOIN fx_grid g ON g.dt = c.dt AND g.y = k.y AND g.x = k.x GROUP BY c.cast_id),
  r AS (SELECT {REGION5} AS region, {SEASON} AS season, c.obs_date, heat.tchp_kj_per_cm2 AS obs, m.pred FROM fx_casts c JOIN heat USING (cast_id) JOIN m USING (cast_id)
    WHERE heat.tchp_kj_per_cm2 IS NOT NULL AND m.pred IS NOT NULL)
  SELECT 'region' AS subset_kind, region AS subset, count(*) AS rows, count(DISTINCT obs_date) AS dates, avg(abs(pred-obs)) AS mae, sqrt(avg(pow(pred-obs, 2))) AS rmse, avg(pred-obs) AS bias
  FROM r GROUP BY region UNION ALL SELECT 'season', season, count(*), count(DISTINCT obs_date), avg(abs(pred-obs)), sqrt(avg(pow(pred-obs, 2))), avg(pred-obs) FROM r GROUP BY season"""
query("flagship_model_error_by_region_season", FLAGSHIP_SQL, "mae rmse bias")(flagship)
