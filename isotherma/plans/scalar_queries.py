"""Scalar functions (F), predicates (P), set operations and limits (U, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import filters as flt
from ..operators.metrics import fixed_draw
from ..sources import readers
from .registry import hav, query

PI2 = "2*pi()"
SEASON = "CASE WHEN month IN (1,2,3) THEN 'winter_jfm' WHEN month IN (7,8,9) THEN 'summer_jas' ELSE 'other' END"
BASIN = "CASE WHEN lon >= -100 AND lon < 20 THEN 'atlantic' WHEN lon >= 20 AND lon < 147 THEN 'indian' ELSE 'pacific' END"
REGION5 = f"CASE WHEN lat < -40 THEN 'southern_high_lat' WHEN lat > 45 THEN 'northern_high_lat' ELSE {BASIN} END"
MOD360 = "(((lon + 180.0) % 360.0) + 360.0) % 360.0"
LAT0 = "CAST(floor(greatest(-89.999999, least(89.999999, lat))/20)*20 AS INT)"
LON0 = f"CAST(floor(({MOD360} - 180.0)/20)*20 AS INT)"
PATCH = f"printf('lat[%d,%d) lon[%d,%d)', {LAT0}, {LAT0}+20, {LON0}, {LON0}+20)"
EXPERT = ("CASE WHEN lat BETWEEN 18 AND 31 AND lon BETWEEN -98 AND -80 THEN 'gulf_of_mexico' "
          "WHEN lon >= -100 AND lon < 20 THEN 'atlantic' WHEN lon >= 20 AND lon < 100 THEN 'indian' "
          "WHEN lon >= 100 AND lon < 160 THEN 'west_pacific' ELSE 'epac_other' END")
BOXES = "(VALUES " + ", ".join(f"('{k}', {la}, {lo})" for k, _n, _b, la, lo in fn.NAMED_BOXES) + ") AS boxes(box_key, lat0, lon0)"


@query("f01_haversine_km", f"SELECT cast_id, {hav('lon', 'lat', '-85.5', '25.25')} AS km FROM fx_casts", "km")
def _(v):
    return v.casts.select("cast_id", fn.haversine_km("lon", "lat", F.lit(-85.5), F.lit(25.25)).alias("km"))


@query("f02_unit_xyz", """SELECT cast_id, cos(radians(lat))*cos(radians(lon)) AS ux, cos(radians(lat))*sin(radians(lon)) AS uy,
  sin(radians(lat)) AS uz FROM fx_casts""", "ux uy uz")
def _(v):
    return v.casts.select("cast_id", *[c.alias(n) for c, n in zip(fn.unit_xyz("lat", "lon"), ("ux", "uy", "uz"))])


@query("f03_chord", """SELECT cast_id, 2*sin(sblt_m*10/(2*6371.0)) AS chord,
  2*6371.0*asin(greatest(0.0, least(1.0, mlt_m/30.0/2))) AS km FROM fx_casts""", "chord km")
def _(v):
    return v.casts.select("cast_id", fn.chord_from_km(F.col("sblt_m") * 10).alias("chord"), fn.km_from_chord(F.col("mlt_m") / 30.0).alias("km"))


@query("f04_cyclic_time", f"""SELECT cast_id, sin(dayofyear(obs_time)*{PI2}/366.0) AS day_sin, cos(dayofyear(obs_time)*{PI2}/366.0) AS day_cos,
  sin(month(obs_time)*{PI2}/12.0) AS month_sin, cos(month(obs_time)*{PI2}/12.0) AS month_cos FROM fx_casts""",
       "day_sin day_cos month_sin month_cos")
def _(v):
    return v.casts.select("cast_id", *[c.alias(n) for n, c in fn.cyclic_time("obs_time").items()])


@query("f05_season_label", f"""SELECT cast_id, {SEASON} AS season, CAST({SEASON} = 'winter_jfm' AS INT) AS is_winter_jfm,
  CAST({SEASON} = 'summer_jas' AS INT) AS is_summer_jas, CAST({SEASON} = 'other' AS INT) AS is_other FROM fx_casts""")
def _(v):
    return v.casts.select("cast_id", fn.season_label("month").alias("season"), *[c.alias(n) for n, c in fn.season_flags("month").items()])


@query("f06_regions", f"""SELECT cast_id, {REGION5} AS region_5, CASE WHEN abs(lat) > 45 THEN 'high_latitude' ELSE {BASIN} END AS macro_region,
  {EXPERT} AS expert_region FROM fx_casts""")
def _(v):
    return v.casts.select("cast_id", fn.region_5("lat", "lon").alias("region_5"), fn.macro_region("lat", "lon").alias("macro_region"),
                          fn.expert_region("lat", "lon").alias("expert_region"))


@query("f07_tiles", f"""SELECT cast_id, printf('tile_%02d_%02d', CAST(floor((lat+90)/15) AS INT), CAST(floor((lon+180)/15) AS INT)) AS tile_15,
  printf('tile_%02d_%02d', CAST(floor((lat+100)/20) AS INT), CAST(floor(((lon+190) % 360)/20) AS INT)) AS tile_20, {PATCH} AS patch FROM fx_casts""")
def _(v):
    return v.casts.select("cast_id", fn.tile15("lat", "lon").alias("tile_15"), fn.tile20("lat", "lon", offset=10.0).alias("tile_20"),
                          fn.patch20("lat", "lon").alias("patch"))


@query("f07_named_box", f"""SELECT cast_id, box_key FROM (SELECT cast_id, {LAT0} AS lat0, {LON0} AS lon0 FROM fx_casts) c
  JOIN {BOXES} USING (lat0, lon0)""")
def _(v):
    boxes = F.broadcast(fn.named_boxes(v.spark))  # eight rows
    rows = v.casts.select("cast_id", fn.patch_south("lat").alias("lat0"), fn.patch_west("lon").alias("lon0"))
    return rows.join(boxes, ["lat0", "lon0"]).select("cast_id", "box_key")


@query("f08_physics_features", """SELECT cast_id, sst_c - 26.0 AS model_temp_excess_26c,
  CASE WHEN sst_c IS NULL THEN -1 ELSE CAST(sst_c >= 26.0 AS INT) END AS model_warm_surface_flag,
  model_d26 - mlt_m AS d26_minus_mlt_m, model_d26 - sblt_m AS d26_minus_sblt_m, model_d26/nullif(mlt_m, 0) AS d26_to_mlt_ratio,
  model_d26/nullif(sblt_m, 0) AS d26_to_sblt_ratio,
  CASE WHEN model_d26 IS NOT NULL AND mlt_m IS NOT NULL THEN greatest(model_d26 - mlt_m, 0.0) END AS warm_layer_thickness_positive_m,
  ssh_m*abs(lat) AS model_ssh_x_abs_lat, mlt_m*abs(lat) AS model_mlt_x_abs_lat, (sst_c-26.0)*abs(lat) AS model_temp_excess_x_abs_lat
  FROM fx_casts""", "model_temp_excess_26c d26_minus_mlt_m d26_minus_sblt_m d26_to_mlt_ratio d26_to_sblt_ratio "
       "warm_layer_thickness_positive_m model_ssh_x_abs_lat model_mlt_x_abs_lat model_temp_excess_x_abs_lat")
def _(v):
    return v.casts.select("cast_id", *[c.alias(n) for n, c in fn.physics_features(d26="model_d26").items()])


@query("f10_enriched_flags", f"""SELECT cast_id, """ + ", ".join(
    f"CAST({REGION5} = '{r}' AS INT) AS region_{r}" for r in ("atlantic", "indian", "pacific", "northern_high_lat", "southern_high_lat"))
    + """, CAST(model_tchp IS NOT NULL AS INT) AS warm_tchp_flag, CAST(model_d26 IS NOT NULL AS INT) AS warm_d26_flag,
  model_tchp*abs(lat) AS model_tchp_x_abs_lat, model_d26*abs(lat) AS model_d26_x_abs_lat FROM fx_casts""",
       "model_tchp_x_abs_lat model_d26_x_abs_lat")
def _(v):
    flags = fn.enriched_flags("model_tchp", "model_d26", "lat", fn.region_5("lat", "lon"))
    return v.casts.select("cast_id", *[c.alias(n) for n, c in flags.items()])


@query("f12_threshold_cell", """SELECT cast_id, CASE WHEN obs_tchp IS NOT NULL AND model_tchp IS NOT NULL THEN 'both_cross'
  WHEN obs_tchp IS NOT NULL THEN 'argo_only' WHEN model_tchp IS NOT NULL THEN 'rtofs_only' ELSE 'neither_cross' END AS cell FROM fx_casts""")
def _(v):
    return v.casts.select("cast_id", fn.threshold_cell("obs_tchp", "model_tchp").alias("cell"))


@query("f13_safe_float", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE)
  AS value FROM orders""", "value")
def _(v):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))
    return v.table("orders").select("o_orderkey", fn.safe_float(text).alias("value"))


@query("f14_keys", """SELECT cast_id, CAST(platform AS VARCHAR) AS platform_id, strftime(obs_time, '%Y%m%d') AS date8,
  upper(event) || '_' || year AS event_name, lower(event) AS slug, 'f' || cast_id || '#prof' || (cast_id % 3) AS obs_key FROM fx_casts""")
def _(v):
    path = F.concat(F.lit("dac/"), F.col("platform").cast("string"), F.lit("/profiles/x.nc"))
    iso = F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.casts.select("cast_id", fn.platform_from_path(path).alias("platform_id"), fn.date8_from_iso(iso).alias("date8"),
                          fn.event_name("event", "year").alias("event_name"), fn.slug("event").alias("slug"),
                          fn.obs_key(F.concat(F.lit("f"), F.col("cast_id").cast("string")), F.col("cast_id") % 3).alias("obs_key"))


@query("f15_month_bounds", """SELECT DISTINCT year, month, strftime(make_date(year, month, 1), '%Y-%m-%d') AS first_day,
  strftime(last_day(make_date(year, month, 1)), '%Y-%m-%d') AS last_day FROM fx_casts""")
def _(v):
    months = v.casts.select("year", "month").distinct()
    return months.select("year", "month", fn.month_first("year", "month").cast("string").alias("first_day"),
                         fn.month_last("year", "month").cast("string").alias("last_day"))


@query("f16_round_half_even", "SELECT cast_id, round_even(mlt_m/8.0, 2) AS half_even FROM fx_casts", "half_even")
def _(v):
    return v.casts.select("cast_id", fn.round_half_even(F.col("mlt_m") / 8.0, 2).alias("half_even"))


@query("f17_flags", """SELECT cast_id, CAST(obs_tchp > 50 AS INT) AS intensifying, CASE WHEN cast_id % 5 >= 3 THEN 'High' WHEN cast_id % 5 >= 1 THEN 'Medium'
  ELSE 'Low' END AS confidence FROM fx_casts""")
def _(v):
    return v.casts.select("cast_id", fn.intensification_flag("obs_tchp").cast("int").alias("intensifying"),
                          fn.confidence(F.col("cast_id") % 5).alias("confidence"))


@query("f19_support_bin", """SELECT cast_id, CASE WHEN km < 50 THEN '0-50' WHEN km < 100 THEN '50-100' WHEN km < 250 THEN '100-250'
  WHEN km < 500 THEN '250-500' ELSE '>500' END AS bin FROM (SELECT cast_id, mlt_m*10.0 AS km FROM fx_casts) t""")
def _(v):
    return v.casts.select("cast_id", fn.support_bin(F.col("mlt_m") * 10.0).alias("bin"))


@query("f20_canonical_date", """SELECT cast_id, strftime(coalesce(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%Y%m%d'), try_strptime(txt, '%Y/%m/%d')),
  '%Y-%m-%d') AS day FROM (SELECT cast_id, CASE cast_id % 4 WHEN 0 THEN strftime(obs_time, '%Y-%m-%d') WHEN 1 THEN strftime(obs_time, '%Y%m%d')
  WHEN 2 THEN strftime(obs_time, '%Y/%m/%d') ELSE 'n/a' END AS txt FROM fx_casts) t""")
def _(v):
    r = F.col("cast_id") % 4
    text = (F.when(r == 0, F.date_format("obs_time", "yyyy-MM-dd")).when(r == 1, F.date_format("obs_time", "yyyyMMdd"))
            .when(r == 2, F.date_format("obs_time", "yyyy/MM/dd")).otherwise("n/a"))
    return v.casts.select("cast_id", fn.canonical_date(text).alias("day"))


@query("p01_qc_levels", "SELECT cast_id, depth_m, temp_c, qc FROM fx_levels WHERE qc IN ('1','2')", "temp_c")
def _(v):
    return flt.qc_levels(v.levels, ["depth_m", "temp_c", "salinity_psu"], ["qc"]).select("cast_id", "depth_m", "temp_c", "qc")


ADJUSTED = """SELECT cast_id, depth_m AS p, temp_c AS t, CASE WHEN cast_id % 3 = 0 THEN NULL WHEN cast_id % 7 = 0 THEN depth_m - 30.0
  ELSE depth_m + CAST(0.5 AS DOUBLE) END AS p_adjusted, CASE WHEN cast_id % 4 = 0 OR k % 2 = 0 THEN NULL ELSE temp_c - CAST(0.1 AS DOUBLE) END AS t_adjusted FROM fx_levels"""


@query("p02_prefer_adjusted", f"""WITH a AS ({ADJUSTED}), u AS (SELECT cast_id, coalesce(max(p_adjusted) <= 12000 AND min(p_adjusted) >= -2, false) AS up,
  count(t_adjusted) > 0 AS ut FROM a GROUP BY cast_id)
  SELECT a.cast_id, CASE WHEN up THEN p_adjusted ELSE p END AS p, CASE WHEN ut THEN t_adjusted ELSE t END AS t FROM a JOIN u USING (cast_id)""", "p t")
def _(v):
    rows = v.levels.selectExpr("cast_id", "depth_m AS p", "temp_c AS t",
                               "CASE WHEN cast_id % 3 = 0 THEN NULL WHEN cast_id % 7 = 0 THEN depth_m - 30.0D ELSE depth_m + 0.5D END AS p_adjusted",
                               "CASE WHEN cast_id % 4 = 0 OR k % 2 = 0 THEN NULL ELSE temp_c - 0.1D END AS t_adjusted")
    return flt.prefer_adjusted(rows, ["cast_id"], ["p", "t"], "p")


@query("p03_clip_surface_pressure", """WITH a AS (SELECT cast_id, k, depth_m - CAST(4.0 + cast_id % 4 AS DOUBLE) AS p FROM fx_levels),
  b AS (SELECT cast_id, k, CASE WHEN p > -2 AND p < 0 THEN 0.0 ELSE p END AS p FROM a)
  SELECT cast_id, k, p FROM b WHERE cast_id NOT IN (SELECT cast_id FROM b WHERE p < 0)""", "p")
def _(v):
    rows = v.levels.select("cast_id", "k", (F.col("depth_m") - (4 + F.col("cast_id") % 4)).alias("p"))
    return flt.clip_surface_pressure(rows, ["cast_id"], "p")


@query("p04_gate_profiles", """SELECT cast_id, depth_m FROM fx_levels WHERE cast_id IN
  (SELECT cast_id FROM fx_levels GROUP BY cast_id HAVING count(*) >= 4 AND max(depth_m) >= 120)""")
def _(v):
    return flt.gate_profiles(v.levels, ["cast_id"], "depth_m", 4, 120.0).select("cast_id", "depth_m")


@query("p05_in_bbox", "SELECT cast_id FROM fx_casts WHERE lat BETWEEN 10 AND 35 AND lon BETWEEN -100 AND -50")
def _(v):
    return v.casts.where(flt.in_bbox(-100, 10, -50, 35)).select("cast_id")


@query("p06_date_window", """SELECT cast_id, month FROM fx_casts WHERE strftime(obs_date, '%Y%m%d') BETWEEN '19960101' AND '19991231' AND month IN (7,8,9)""")
def _(v):
    inside = flt.date_window(F.date_format("obs_date", "yyyyMMdd"), "19960101", "19991231")
    return v.casts.where(inside & flt.month_filter("month", "JAS")).select("cast_id", "month")


@query("p07_complete_pairs", "SELECT cast_id FROM fx_casts WHERE obs_tchp IS NOT NULL AND model_tchp IS NOT NULL AND obs_d26 IS NOT NULL")
def _(v):
    return flt.complete_pairs(v.casts, ["obs_tchp", "model_tchp", "obs_d26"]).select("cast_id")


@query("p08_valid_range", "SELECT cast_id, ssh_m FROM fx_casts WHERE ssh_m BETWEEN 0.3 AND 3.2", "ssh_m")
def _(v):
    return v.casts.where(flt.valid_range("ssh_m", *flt.STERIC_RANGE_M)).select("cast_id", "ssh_m")


@query("p09_stride_thin", """SELECT strftime(dt, '%Y-%m-%d') AS dt, y, x, sst_c FROM fx_grid
  WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL AND lat BETWEEN -40 AND 40""", "sst_c")
def _(v):
    rows = flt.stride_thin(v.grid, 2, "sst_c", F.col("lat").between(-40, 40))
    return rows.select(F.col("dt").cast("string").alias("dt"), "y", "x", "sst_c")


@query("p10_require_columns", " UNION ALL ".join(f"SELECT '{n}' AS recipe, count(*) AS rows FROM fx_casts WHERE {c} IS NOT NULL" for n, c in (("model", "model_tchp + model_d26 + ssh_m"), ("observed", "obs_tchp + obs_d26"))))
def _(v):
    """Complete rows of each recipe that the table can serve; one that only lacks an optional column is skipped."""
    recipes = {"model": ["model_tchp", "model_d26", "ssh_m"], "observed": ["obs_tchp", "obs_d26"], "climatology": ["model_tchp", "clim_tchp"]}
    usable = {n: c for n, r in recipes.items() if (c := flt.require_columns(v.casts, r, ["clim_tchp"]))}
    counts = F.array(*[F.struct(F.lit(n).alias("recipe"), F.count_if(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in r))).alias("rows")) for n, r in usable.items()])
    return v.casts.agg(counts.alias("_c")).select(F.inline("_c"))


@query("p09_stride_thin_limited", """SELECT strftime(dt, '%Y-%m-%d') AS dt, y, x, sst_c FROM fx_grid WHERE y % 2 = 0 AND x % 2 = 0 AND sst_c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY y, x) <= 7""", "sst_c")
def _(v):
    return flt.stride_thin(v.grid, 2, "sst_c", limit=7).select(F.col("dt").cast("string").alias("dt"), "y", "x", "sst_c")


@query("o01_sorted_pairs", "SELECT cast_id, platform, obs_tchp FROM fx_casts WHERE obs_tchp IS NOT NULL ORDER BY platform, obs_tchp, cast_id", "obs_tchp")
def _(v):
    return flt.complete_pairs(v.casts, ["obs_tchp"]).select("cast_id", "platform", "obs_tchp").orderBy("platform", "obs_tchp", "cast_id")


@query("o02_top_n", "SELECT cast_id, obs_tchp FROM fx_casts ORDER BY obs_tchp DESC NULLS LAST, cast_id LIMIT 20", "obs_tchp")
def _(v):
    return flt.top_n(v.casts.select("cast_id", "obs_tchp"), 20, F.desc_nulls_last("obs_tchp"), F.asc("cast_id"))


@query("o03_capped_per_platform", """SELECT cast_id, platform FROM (SELECT cast_id, platform, row_number() OVER (PARTITION BY platform ORDER BY cast_id) AS rn
  FROM fx_casts) t WHERE rn <= 3 ORDER BY cast_id LIMIT 1000""")
def _(v):
    return flt.capped_per_platform(v.casts.select("cast_id", "platform"), "platform", "cast_id", 3, 1000).select("cast_id", "platform")


@query("o04_even_sample", """SELECT cast_id FROM (SELECT cast_id, row_number() OVER (ORDER BY cast_id) - 1 AS p, count(*) OVER () AS n FROM fx_casts) t
  WHERE p IN (SELECT (i * ((SELECT count(*) FROM fx_casts) - 1)) // 499 FROM range(500) r(i))""")
def _(v):
    return flt.even_sample(v.casts.select("cast_id"), 500, "cast_id")


@query("o05_seeded_sample", f"SELECT y, x, cell FROM (SELECT DISTINCT y, x, y*100000 + x AS cell FROM fx_grid) t ORDER BY {fixed_draw('7::BIGINT', '(cell % 2147483647)::BIGINT', '4294967296', xor=lambda a, b: f'xor({a}, {b})', div='//')}, cell LIMIT 200")
def _(v):
    return flt.seeded_sample(v.geometry.select("y", "x", (F.col("y") * 100000 + F.col("x")).alias("cell")), 200, "cell", 7)


@query("u01_union_tables", """SELECT cast_id, obs_tchp AS value, 'obs' AS source FROM fx_casts UNION ALL
  SELECT cast_id, model_tchp, 'model' FROM fx_casts""", "value")
def _(v):
    a = v.casts.select("cast_id", F.col("obs_tchp").alias("value"), F.lit("obs").alias("source"))
    b = v.casts.select("cast_id", F.col("model_tchp").alias("value"), F.lit("model").alias("source"))
    return flt.union_tables(a, b)


@query("u02_in_both", """SELECT DISTINCT platform FROM fx_casts WHERE year <= 1997 INTERSECT SELECT DISTINCT platform FROM fx_casts WHERE year >= 1998""")
def _(v):
    return flt.in_both(v.casts.where("year <= 1997"), v.casts.where("year >= 1998"), "platform")


@query("u03_only_left", """SELECT DISTINCT strftime(obs_date, '%Y-%m-%d') AS day FROM fx_casts WHERE event = '1-URGENT' EXCEPT
  SELECT DISTINCT strftime(obs_date, '%Y-%m-%d') FROM fx_casts WHERE event <> '1-URGENT'""")
def _(v):
    days = v.casts.select(F.col("obs_date").cast("string").alias("day"), "event")
    return flt.only_left(days.where("event = '1-URGENT'"), days.where("event <> '1-URGENT'"), "day")


@query("u04_season_union", "SELECT month, count(*) AS n FROM fx_casts WHERE month IN (1,2,3,7,8,9) GROUP BY month")
def _(v):
    months = flt.season_union(["JFM", "JAS"])
    return v.casts.where(F.col("month").isin(*months)).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("s08_union_products", """SELECT cast_id, obs_tchp*1e7 AS ohc_j_per_m2 FROM fx_casts WHERE year < 1998 UNION ALL
  SELECT cast_id, model_tchp*1e7 FROM fx_casts WHERE year >= 1998""", "ohc_j_per_m2")
def _(v):
    old = v.casts.where("year < 1998").select("cast_id", (F.col("obs_tchp") * 1e7).alias("integral_j_per_m2"))
    new = v.casts.where("year >= 1998").select("cast_id", (F.col("model_tchp") * 1e7).alias("ohc_j_per_m2"))
    return readers.union_products([old, new])


@query("s09_grid_contract", """SELECT strftime(dt, '%Y-%m-%d') AS dt, y, x, lon, sst_c FROM fx_grid""", "lon sst_c")
def _(v):
    from ..operators.grids import grid_contract
    raw = v.grid.withColumn("sst_c", F.coalesce("sst_c", F.lit(1.2676506e30))).withColumn("lon", F.col("lon") + 360.0)
    return grid_contract(raw, ["sst_c"]).select(F.col("dt").cast("string").alias("dt"), "y", "x", "lon", "sst_c")


@query("s10_dates_available", "SELECT DISTINCT strftime(obs_date, '%Y%m%d') AS date FROM fx_casts ORDER BY date")
def _(v):
    names = v.casts.select(F.concat(F.lit("field_v2_"), F.date_format("obs_date", "yyyyMMdd"), F.lit(".nc")).alias("file"))
    return readers.dates_from_names(names, "file")


NAME = "CONCAT('model_interp_', replace(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '_m' WHEN 1 THEN '_kj_per_cm2' WHEN 2 THEN '_km' ELSE '_ratio' END)"


@query("f18_names_and_units", f"""SELECT p_partkey, regexp_replace(regexp_replace({NAME}, '^model_(interp_)?', ''), '_(kj_per_cm2|m|km|c|s2)$', '') AS short_name,
  CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'kJ/cm²' WHEN 2 THEN 'km' ELSE '–' END AS units FROM part""")
def _(v):
    names = v.table("part").select("p_partkey", F.expr(NAME).alias("name"))
    return names.select("p_partkey", fn.short_name("name").alias("short_name"), fn.units_of("name").alias("units"))


@query("p11_common_support", "SELECT cast_id FROM fx_casts WHERE obs_tchp IS NOT NULL AND model_tchp IS NOT NULL AND corrected_tchp IS NOT NULL AND obs_d26 IS NOT NULL")
def _(v):
    return flt.common_support(v.casts, ["obs_tchp", "model_tchp", "corrected_tchp", "obs_d26"]).select("cast_id")
