"""Sinks (S5-S7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY_BUCKETS = 64


def write_product(df: DataFrame, path: str, csv: bool = False) -> None:
    """One table partitioned by year; a year is a folder of it. CSV copies on request."""
    df.write.mode("overwrite").partitionBy("year").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").partitionBy("year").option("header", True).csv(f"{path}/csv")


def key_bucket(key: str, buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append_new(df: DataFrame, target: str, key: str, buckets: int = KEY_BUCKETS) -> None:
    """Append the rows whose key is not written yet; failures are rows with an ``error`` text.

    The batch is first reduced to one row per key, a success before a failure, so a repeated run adds nothing. The target has a folder per
    hash bucket of the key (column ``key_bucket``), so a batch reads the keys of its own buckets only; the rows are the index, there is
    no second table to keep in step. NULL keys count as new each time.
    """
    spark = df.sparkSession
    rows = df.withColumn("key_bucket", key_bucket(key, buckets))
    if "error" in df.columns:
        first = Window.partitionBy("key_bucket", key).orderBy(F.col("error").asc_nulls_first())
        fresh = rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    else:
        fresh = rows.dropDuplicates(["key_bucket", key])
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = [r[0] for r in rows.select("key_bucket").distinct().collect()]  # at most as many as there are buckets
        fresh = fresh.join(known_keys(spark, target, key, touched), ["key_bucket", key], "left_anti").select(*rows.columns)
    fresh.repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(target)


def known_keys(spark: SparkSession, target: str, key: str, touched: Sequence[int]) -> DataFrame:
    """Keys that ``append_new`` has written to some buckets; only their folders are read."""
    return spark.read.parquet(target).where(F.col("key_bucket").isin(*touched)).select("key_bucket", key)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """A table of the catalog in buckets of the key. Tables with as many buckets join on the key without a shuffle, and a lookup of
    given keys reads their buckets only."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


TILE_DEGREES = 10


def layer_documents(points: DataFrame, stride: int, bbox: list[float] | None = None) -> DataFrame:
    """One JSON document per date, layer and tile of 10 degrees, whatever the size of the layer.

    A tile is numbered row by row from the south-west; its area bounds the document. Together the documents hold every point.
    """
    per_row = 360 // TILE_DEGREES
    tile = F.floor((F.col("lat") + 90) / TILE_DEGREES) * per_row + F.floor((F.col("lon") + 180) / TILE_DEGREES)
    docs = points.withColumn("tile", tile.cast("int")).groupBy("dt", "layer", "tile").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.sort_array(F.collect_list(F.struct("lat", "lon", "value"))).alias("points"))
    box = F.array(*[F.lit(float(b)) for b in bbox]) if bbox else F.lit(None).cast("array<double>")
    body = F.struct(F.col("layer"), F.col("dt").cast("string").alias("time"), "tile", "point_count", F.lit(stride).alias("stride"),
                    box.alias("bbox"), "value_min", "value_max", "points")
    return docs.select("dt", "layer", "tile", F.to_json(body).alias("document"))


def export_layer(points: DataFrame, path: str, stride: int, bbox: list[float] | None = None) -> None:
    docs = layer_documents(points, stride, bbox).select("dt", "layer", F.col("document").alias("value"))
    docs.write.mode("overwrite").partitionBy("dt", "layer").text(path)
