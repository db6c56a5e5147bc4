"""Ocean-shaped views over the shared test tables.

The text of each view is read by Spark and, inside a WITH clause, by the SQL check. All
views use whole tables: the model grid has one cell per ``part`` row and thirty days, so it
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_FIRST_DAY = "2024-01-01"
GRID_DAYS = 30

CASTS = """
SELECT o_orderkey AS cast_id, o_custkey AS platform, o_orderdate AS obs_time,
  CAST(o_orderdate AS DATE) AS obs_date,
  DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS dt,
  CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  o_orderpriority AS event,
  CAST((o_orderkey*7919 + o_custkey*31) % 12000 AS DOUBLE)/100.0 - 60.0 AS lat,
  CAST((o_orderkey*104729 + o_custkey*17) % 36000 AS DOUBLE)/100.0 - 180.0 AS lon,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_totalprice/2500.0 END AS obs_tchp,
  CASE WHEN o_orderkey % 10 IN (2,3) THEN NULL
       ELSE o_totalprice/2500.0*0.9 + CAST(o_orderkey % 23 AS DOUBLE) - 11.0 END AS model_tchp,
  CASE WHEN o_orderkey % 10 IN (2,3) THEN NULL
       ELSE o_totalprice/2500.0*0.95 + CAST(o_orderkey % 13 AS DOUBLE) - 5.0 END AS corrected_tchp,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE 20.0 + o_totalprice/8000.0 END AS obs_d26,
  CASE WHEN o_orderkey % 10 IN (2,3) THEN NULL
       ELSE 15.0 + o_totalprice/8000.0 + CAST(o_orderkey % 17 AS DOUBLE) END AS model_d26,
  27.0 + CAST(o_custkey % 50 AS DOUBLE)/10.0 - abs(CAST((o_orderkey*7919 + o_custkey*31) % 12000 AS DOUBLE)/100.0 - 60.0)/8.0 AS sst_c,
  CAST(o_orderkey % 41 AS DOUBLE)/20.0 - 1.0 AS ssh_m,
  CAST(o_orderkey % 60 AS DOUBLE) AS mlt_m,
  CAST(o_custkey % 37 AS DOUBLE) AS sblt_m
FROM {orders}
"""

LEVELS = """
SELECT l_orderkey AS cast_id, l_quantity*4.0 AS depth_m, CAST(l_quantity AS INT) AS k,
  max(30.5 - 0.18*l_quantity + 10.0*l_discount) AS temp_c,
  max(34.0 + 20.0*l_tax) AS salinity_psu,
  max(1021.0 + 0.06*l_quantity + 5.0*l_tax) AS rho, max(3990.0 + 0.2*l_quantity) AS cp,
  max(21.0 + 0.05*l_quantity - 2.0*l_discount) AS sigma0,
  max(CASE l_returnflag WHEN 'N' THEN '1' WHEN 'A' THEN '2' ELSE '4' END) AS qc
FROM {lineitem} GROUP BY l_orderkey, l_quantity
"""

OBS = """
SELECT event_id AS obs_id, user_id AS platform, ts AS obs_time, CAST(ts AS DATE) AS dt,
  CAST((event_id*7919 + user_id*31) % 11900 AS DOUBLE)/100.0 - 59.5 AS lat,
  CAST((event_id*104729 + user_id*17) % 36000 AS DOUBLE)/100.0 - 180.0 AS lon,
  value AS obs_value, event_type AS storm
FROM {events}
"""

# Cells of the static model geometry: nx columns, ny rows, latitude -60 to 60.
GEOMETRY = """
SELECT CAST(floor(p_partkey / nx) AS INT) AS y, CAST(p_partkey % nx AS INT) AS x,
  -60.0 + 120.0*(CAST(floor(p_partkey / nx) AS DOUBLE) + CAST(0.5 AS DOUBLE))/ny AS lat,
  -180.0 + 360.0*(CAST(p_partkey % nx AS DOUBLE) + CAST(0.5 AS DOUBLE))/nx AS lon, nx, ny
FROM (SELECT p_partkey, nx, CAST(ceil(CAST(n AS DOUBLE)/nx) AS INT) AS ny
      FROM (SELECT p_partkey, n, CAST(2*ceil(sqrt(CAST(n AS DOUBLE)/2)) AS INT) AS nx
            FROM (SELECT p_partkey, (SELECT count(*) FROM {part}) AS n FROM {part}) a) b) c
"""

GRID_BODY = """
SELECT dt, y, x, lat, lon, nx, ny, sst_c,
  CASE WHEN sst_c >= 26.0 THEN 8.0*(sst_c - 22.0) END AS tchp,
  CASE WHEN sst_c >= 26.0 THEN 30.0 + 12.0*(sst_c - 26.0) END AS d26
FROM (SELECT dt, y, x, lat, lon, nx, ny,
  CASE WHEN (y*7 + x*13) % 11 = 0 THEN NULL ELSE 29.0 - abs(lat)/6.0
    + CAST((y*31 + x*17 + day(dt)*7) % 100 AS DOUBLE)/50.0 END AS sst_c FROM {days}) g
"""

_DUCK_DAYS = ("(SELECT *, DATE '2024-01-01' + CAST(d AS INT) AS dt FROM "
              "(SELECT *, unnest(range(30)) AS d FROM fx_geometry) e)")

SQL_VIEWS = {
    "fx_casts": CASTS.format(orders="orders"),
    "fx_levels": LEVELS.format(lineitem="lineitem"),
    "fx_obs": OBS.format(events="events"),
    "fx_geometry": GEOMETRY.format(part="part"),
    "fx_grid": GRID_BODY.format(days=_DUCK_DAYS),
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names."""
    names = [n for n in SQL_VIEWS if n in sql]
    if "fx_grid" in names and "fx_geometry" not in names:
        names.insert(names.index("fx_grid"), "fx_geometry")
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def casts(self) -> DataFrame:
        return self.spark.sql(CASTS, orders=self.table("orders"))

    @property
    def levels(self) -> DataFrame:
        return self.spark.sql(LEVELS, lineitem=self.table("lineitem"))

    @property
    def obs(self) -> DataFrame:
        return self.spark.sql(OBS, events=self.table("events"))

    @property
    def geometry(self) -> DataFrame:
        return self.spark.sql(GEOMETRY, part=self.table("part"))

    @property
    def grid(self) -> DataFrame:
        days = F.expr(f"sequence(DATE '{GRID_FIRST_DAY}', DATE '{GRID_FIRST_DAY}' + {GRID_DAYS - 1})")
        return self.spark.sql(GRID_BODY, days=self.geometry.withColumn("dt", F.explode(days)))
