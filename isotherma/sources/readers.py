"""Sources (S1-S4, S8-S10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import platform_from_path
from ..functions.numbers import null_non_finite, safe_float

# The track columns in file order.
TRACK_COLUMNS = [
    "sid", "season", "basin", "name", "iso_time", "latitude", "longitude", "wmo_wind", "wmo_pres", "usa_wind", "usa_pres",
    "usa_sshs", "nature", "dist2land", "landfall", "storm_speed", "storm_dir",
]
PAIR_TEXT = ["cast_id", "platform", "obs_time", "obs_date", "storm_name"]
PAIR_INT = ["storm_season"]
PAIR_NUMBERS = [
    "lat", "lon", "obs_surface_t_c", "obs_d26_m", "obs_tchp_kj_cm2", "obs_max_depth_m", "model_grid_lat", "model_grid_lon",
    "model_grid_distance_km", "model_surface_t_c", "model_d26_m", "model_tchp_kj_cm2", "model_max_depth_m", "tchp_delta_kj_cm2",
]


def read_observations(spark: SparkSession, path: str, columns: Sequence[str], years: Sequence[int] = (),
                      months: Sequence[int] = ()) -> DataFrame:
    """Listed columns of the usable rows; filters and columns reach the scan."""
    rows = spark.read.parquet(path)
    if "error" in rows.columns:
        rows = rows.where(F.col("error").isNull())
    if years:
        rows = rows.where(F.col("year").isin(*years))
    if months:
        rows = rows.where(F.col("month").isin(*months))
    return null_non_finite(rows.select(*columns))


def read_pairs(spark: SparkSession, path: str, event: str) -> DataFrame:
    """Pair table of one event ``NAME_YEAR``; storm columns are filled from it when the file has none.

    Columns are matched by header name; ``obs_date`` stays text.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    name, _, year = event.rpartition("_")
    has = set(raw.columns)
    text = [F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in PAIR_TEXT]
    ints = [(F.col(c).try_cast("int") if c in has else F.lit(None).cast("int")).alias(c) for c in PAIR_INT]
    nums = [(safe_float(c) if c in has else F.lit(None).cast("double")).alias(c) for c in PAIR_NUMBERS]
    rows = raw.select(*text, *ints, *nums)
    return rows.withColumn("storm_name", F.coalesce("storm_name", F.lit(name))).withColumn(
        "storm_season", F.coalesce("storm_season", F.lit(int(year))))


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """S3: storm track; the units row under the header has no numeric latitude and is dropped."""
    schema = ", ".join(f"{c} string" for c in TRACK_COLUMNS)
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    rows = rows.withColumn("lat", safe_float("latitude")).withColumn("lon", safe_float("longitude"))
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.withColumn("iso_time", F.try_to_timestamp("iso_time")).drop("latitude", "longitude")


def read_cast_index(spark: SparkSession, path: str) -> DataFrame:
    """Cast index with ``#`` comments; short rows and rows without a position are dropped."""
    rows = spark.read.csv(path, header=True, comment="#", mode="DROPMALFORMED")
    rows = rows.withColumn("lat", safe_float("latitude")).withColumn("lon", safe_float("longitude"))
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).drop("latitude", "longitude")
    return rows.withColumn("platform", platform_from_path("file"))


def union_products(frames: Sequence[DataFrame], renames: dict[str, str] | None = None) -> DataFrame:
    """Batches with old column names, as one table."""
    renames = {"integral_j_per_m2": "ohc_j_per_m2"} if renames is None else renames
    out = None
    for f in frames:
        for old, new in renames.items():
            if old in f.columns and new not in f.columns:
                f = f.withColumnRenamed(old, new)
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def dates_available(df: DataFrame, date: str = "dt") -> DataFrame:
    """Distinct dates of a table, sorted."""
    return df.select(date).distinct().orderBy(date)


def dates_from_names(names: DataFrame, column: str) -> DataFrame:
    """Eight-digit dates inside file names, distinct and sorted."""
    found = names.select(F.regexp_extract(column, r"(?<!\d)(\d{8})(?!\d)", 1).alias("date"))
    return found.where(F.col("date") != "").distinct().orderBy("date")
