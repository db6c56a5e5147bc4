"""Hand-computed profiles for every branch of the profile operators."""

import pytest
from pyspark.sql import functions as F

from isotherma.operators import profiles as prof
from isotherma.operators.ordered import exact_quantiles, running_counts, scan


def levels(spark, rows, schema="cast_id string, depth_m double, temp_c double"):
    return spark.createDataFrame(rows, schema)


CASES = {
    "one_level": ([(0, 28)], None, None),
    "cold_surface": ([(0, 25.9), (10, 25)], None, None),
    "never_crosses": ([(0, 29), (10, 28), (500, 27)], None, None),
    "linear": ([(0, 28), (10, 27), (20, 25)], 15.0, 15.0 + 2.5),  # (2+1)/2*10 + 1/2*5
    "on_level": ([(0, 28), (10, 26), (20, 24)], 10.0, 10.0),
    "equal_at_crossing": ([(0, 26), (10, 26), (20, 25)], 10.0, 0.0),
    "starts_at_reference": ([(0, 26), (10, 25)], 0.0, 0.0),
    "starts_below_surface": ([(5, 28), (15, 24)], 10.0, 5.0),
    "warm_again_below": ([(0, 28), (10, 24), (20, 27), (30, 20)], 5.0, 5.0),
    "crosses_segments": ([(0, 30), (240, 29), (260, 28), (900, 27), (1100, 25)], 1000.0, 840 + 50 + 960 + 50),
}


@pytest.mark.parametrize("name", CASES)
def test_heat_excess_trapezoid(spark, name):
    points, d26, integral = CASES[name]
    df = levels(spark, [(name, float(z), float(t)) for z, t in points])
    got = prof.heat_excess_trapezoid(df, rho=1.0, cp=1.0).collect()[0]
    assert got["d26_m"] == (None if d26 is None else pytest.approx(d26))
    assert got["integral_j_per_m2"] == (None if integral is None else pytest.approx(integral))
    assert got["max_depth_m"] == max(z for z, _ in points)


def test_non_finite_levels_are_dropped(spark):
    df = levels(spark, [("a", 0.0, 28.0), ("a", 5.0, float("nan")), ("a", None, 20.0), ("a", 10.0, 24.0)])
    assert prof.isotherm_depth(df).collect()[0]["d26_m"] == pytest.approx(5.0)


def test_layers_integrate_from_the_surface(spark):
    rows = [("a", 1, 10 * 9806.0, 28.0), ("a", 2, 10 * 9806.0, 27.0), ("a", 3, 10 * 9806.0, 25.0)]
    df = spark.createDataFrame(rows, "cast_id string, k int, thk_pa double, temp_c double").withColumn("salinity_psu", F.lit(35.0))
    got = prof.heat_excess_layers(df, rho=1.0, cp=1.0).collect()[0]
    assert got["d26_m"] == pytest.approx(20.0)
    assert got["ohc_j_per_m2"] == pytest.approx(10 * 2 + 10 * 1)


def test_layers_with_equal_bracket_stay_null(spark):
    rows = [("a", 1, 9806.0, 26.0), ("a", 2, 9806.0, 26.0)]
    df = spark.createDataFrame(rows, "cast_id string, k int, thk_pa double, temp_c double").withColumn("salinity_psu", F.lit(35.0))
    assert prof.heat_excess_layers(df).collect()[0]["d26_m"] is None


def test_non_positive_thickness_counts_as_nothing(spark):
    rows = [("a", 1, 10 * 9806.0, 28.0), ("a", 2, -5.0, 20.0), ("a", 3, 10 * 9806.0, 24.0)]
    df = spark.createDataFrame(rows, "cast_id string, k int, thk_pa double, temp_c double").withColumn("salinity_psu", F.lit(35.0))
    got = prof.heat_excess_layers(df, rho=1.0, cp=1.0).collect()[0]
    # The bracket is the invalid layer (20) and layer 3 (24), extrapolated: 10 + (20-26)/(20-24)*(15-10) = 17.5
    assert got["d26_m"] == pytest.approx(17.5)
    assert got["ohc_j_per_m2"] == pytest.approx(20.0)


def test_first_crossing_at_the_first_level(spark):
    df = levels(spark, [("a", 3.0, 20.0), ("a", 9.0, 10.0)])
    assert prof.first_crossing_depth(df, 25.0, increasing=False).collect()[0][1] == 3.0
    assert prof.first_crossing_depth(df, 15.0, increasing=False).collect()[0][1] == pytest.approx(6.0)
    assert prof.first_crossing_depth(df, 5.0, increasing=False).collect()[0][1] is None


def test_inversions(spark):
    rows = [(0, 20.0), (10, 19.0), (20, 19.5), (30, 19.6), (40, 18.0), (50, 18.02), (60, 17.0), (70, 18.0)]
    df = spark.createDataFrame([("a", float(z), t, 22 + z / 10) for z, t in rows], "cast_id string, depth_m double, temp_c double, sigma0 double")
    got = sorted((r["z_top"], r["z_bottom"], round(r["dt"], 6)) for r in prof.inversion_bands(df).collect())
    assert got == [(10.0, 30.0, 0.6), (60.0, 70.0, 1.0)]


def test_vertical_axis():
    assert prof.check_vertical_axis("depth") == "depth"
    with pytest.raises(ValueError):
        prof.check_vertical_axis("height")


def test_scan_equals_a_plain_window(spark):
    df = spark.range(2000).select((F.col("id") % 7 == 0).cast("int").alias("key"), (F.col("id") * 1.7 % 1000).alias("z"), (F.col("id") * 31 % 97).cast("double").alias("v"))
    from pyspark.sql import Window
    w = Window.partitionBy("key").orderBy("z", "v")
    got = scan(df, ["key"], "z", 50.0, carry=["v"], sums={"total": F.col("v")})
    a = sorted(map(tuple, got.select("key", "z", "v", F.col("_prev.z"), "total", F.col("_head.z")).collect()), key=str)
    b = df.select("key", "z", "v", F.lag("z").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("z").over(w))
    assert a == sorted(map(tuple, b.collect()), key=str)


def test_quantiles_and_counts_with_a_hot_value(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") * 0.37 % 50).alias("v"))
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.937, 1.0], 16).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.5, 0.937, 1.0)])).alias("q")).collect()
    for r in want:
        for p, q in zip((0.0, 0.1, 0.5, 0.937, 1.0), r["q"]):
            assert got[(r["g"], p)] == pytest.approx(q)
    assert running_counts(df, [], "v").agg(F.sum("cnt"), F.max("total")).first()[:] == (3000, 3000)
