"""Sources and sinks: given tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins
from ..session import shared_folder
from ..sources import readers, writers
from ..streaming.incremental import append_stream
from .registry import query


def place(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_read_observations", """SELECT cast_id, lat, lon, obs_tchp FROM fx_casts WHERE cast_id % 17 <> 0 AND year IN (1996, 1997) AND month BETWEEN 1 AND 6""", "lat lon obs_tchp")
def _(v):
    path = place(v, "observations")
    v.casts.withColumn("error", F.when(F.col("cast_id") % 17 == 0, "failed")).select(
        "cast_id", "lat", "lon", "obs_tchp", "sst_c", "year", "month", "error").write.parquet(path)
    return readers.read_observations(v.spark, path, ["cast_id", "lat", "lon", "obs_tchp"], (1996, 1997), range(1, 7))


@query("s02_read_pairs", """SELECT CAST(cast_id AS VARCHAR) AS cast_id, CAST(platform AS VARCHAR) AS platform, CASE WHEN cast_id % 11 <> 0 THEN lat END AS lat, lon, obs_tchp AS obs_tchp_kj_cm2,
  'IAN' AS storm_name, CAST(2022 AS INT) AS storm_season FROM fx_casts""", "lat lon obs_tchp_kj_cm2")
def _(v):
    path = place(v, "pairs")
    lat = F.when(F.col("cast_id") % 11 != 0, F.col("lat").cast("string")).otherwise("n/a")
    v.casts.select("lon", lat.alias("lat"), "cast_id", "platform", F.col("obs_tchp").alias("obs_tchp_kj_cm2")).write.option("header", True).csv(path)
    rows = readers.read_pairs(v.spark, path, "IAN_2022")
    return rows.select("cast_id", "platform", "lat", "lon", "obs_tchp_kj_cm2", "storm_name", "storm_season")


@query("s03_read_track", """SELECT CAST(obs_id AS VARCHAR) AS sid, storm AS name, strftime(obs_time, '%Y-%m-%d %H:%M:%S') AS at, lat, lon FROM fx_obs WHERE obs_id % 50 <> 0""", "lat lon")
def _(v):
    path = place(v, "track")
    text = {"sid": F.col("obs_id").cast("string"), "name": F.col("storm"), "iso_time": F.date_format("obs_time", "yyyy-MM-dd HH:mm:ss"),
            "latitude": F.when(F.col("obs_id") % 50 == 0, "degrees_north").otherwise(F.col("lat").cast("string")), "longitude": F.col("lon").cast("string")}
    v.obs.select(*[text.get(c, F.lit("0")).alias(c) for c in readers.TRACK_COLUMNS]).write.option("header", True).csv(path)
    return readers.read_track(v.spark, path).select("sid", "name", F.date_format("iso_time", "yyyy-MM-dd HH:mm:ss").alias("at"), "lat", "lon")


@query("s04_read_cast_index", """SELECT CAST(cast_id AS VARCHAR) AS cast, lat, lon FROM fx_casts WHERE cast_id % 7 <> 1""", "lat lon")
def _(v):
    path = place(v, "index")
    kind = F.col("cast_id") % 7  # 1: no position
    name = F.concat(F.lit("dac/"), F.col("platform").cast("string"), F.lit("/profiles/D"), F.col("platform").cast("string"), F.lit("_001.nc"))
    v.casts.select(name.alias("file"), F.when(kind != 1, F.col("lat").cast("string")).alias("latitude"), F.col("lon").alias("longitude"), F.col("cast_id").alias("cast")).write.option("header", True).csv(path)
    return readers.read_cast_index(v.spark, path).select("cast", "lat", "lon")


@query("s05_write_product", "SELECT cast_id, CAST(year AS INT) AS year, obs_tchp FROM fx_casts", "obs_tchp")
def _(v):
    path = place(v, "product")
    writers.write_product(v.casts.select("cast_id", "year", "obs_tchp"), path)
    return v.spark.read.parquet(f"{path}/parquet").select("cast_id", "year", "obs_tchp")


@query("s06_append_new", "SELECT cast_id, obs_tchp, CASE WHEN cast_id % 2 = 0 AND cast_id % 5 = 0 THEN 'early' END AS error FROM fx_casts", "obs_tchp")
def _(v):
    path = place(v, "append")
    rows = v.casts.select("cast_id", "obs_tchp")
    first = rows.where("cast_id % 2 = 0").withColumn("error", F.when(F.col("cast_id") % 5 == 0, "early"))
    writers.append_new(first, path, "cast_id")
    failed = rows.where("cast_id % 3 = 0").withColumn("error", F.lit("late"))
    writers.append_new(failed.unionByName(rows.withColumn("error", F.lit(None).cast("string"))), path, "cast_id")
    return v.spark.read.parquet(path).drop("key_bucket")


@query("s06_append_stream", "SELECT cast_id, obs_tchp FROM fx_casts", "obs_tchp")
def _(v):
    source, target, state = (place(v, x) for x in ("stream-in", "stream-out", "stream-state"))
    rows = v.casts.select("cast_id", "obs_tchp")
    for part in (rows.where("cast_id % 2 = 0"), rows):
        part.write.mode("append").parquet(source)
        append_stream(v.spark, source, rows.schema, "cast_id", target, state).awaitTermination()
    return v.spark.read.parquet(target).drop("key_bucket")


@query("s10_dates_of_table", "SELECT DISTINCT strftime(dt, '%Y-%m-%d') AS dt FROM fx_obs ORDER BY dt")
def _(v):
    return readers.dates_available(v.obs).select(F.col("dt").cast("string").alias("dt"))


@query("j11_climatology_lookup", """WITH o AS (SELECT cast_id, month, model_tchp, least(greatest(CAST(floor(lat + 90.0) AS INT), 0), 179) AS ilat, least(greatest(CAST(floor(lon + 180.0) AS INT), 0), 359) AS ilon FROM fx_casts),
  c AS (SELECT month, ilat, ilon, avg(model_tchp) AS clim FROM o GROUP BY ALL)
  SELECT o.cast_id, o.ilat, o.ilon, c.clim FROM o LEFT JOIN c USING (month, ilat, ilon)""", "clim")
def _(v):
    cells = v.casts.select(
        "month", "model_tchp", joins.climatology_cell("lat", -89.5, n=180).alias("ilat"), joins.climatology_cell("lon", -179.5, n=360).alias("ilon"))
    clim = cells.groupBy("month", "ilat", "ilon").agg(F.avg("model_tchp").alias("clim"))
    return joins.climatology_lookup(v.casts, clim, ["clim"]).select("cast_id", "ilat", "ilon", "clim")
