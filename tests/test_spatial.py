"""Spatial joins against brute force, with poles, dateline, crowds and exact hits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from isotherma.operators import blocks, grids, profiles, spatial


def km(a, b):
    (lat1, lon1), (lat2, lon2) = [(math.radians(p[0]), math.radians(p[1])) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return round(2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))), 6)


def scattered(seed, n):
    r = random.Random(seed)
    out = [(90.0, 0.0), (-90.0, 120.0), (0.0, 180.0), (0.0, -180.0), (89.9, -179.9), (-89.9, 10.0), (10.0, 179.999), (10.0, -179.999)]
    while len(out) < n // 2:
        out.append((math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)))
    while len(out) < n * 3 // 4:  # a crowd around one place
        out.append((20 + r.gauss(0, 0.001), -60 + r.gauss(0, 0.001)))
    while len(out) < n:  # copies of one position
        out.append((20.5, -60.5))
    return out


def frame(spark, pts, key):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], f"{key} int, lat double, lon double")


@pytest.mark.parametrize("leaf", [4, 512])
def test_knn_equals_brute_force(spark, leaf):
    qs, ps = scattered(1, 120), scattered(2, 400)
    got = {}
    near = spatial.knn_join(frame(spark, qs, "q"), frame(spark, ps, "p"), 5, query_cols=["q"], point_cols=["p"], tie=["p"], leaf=leaf)
    for r in near.collect():
        got.setdefault(r["q"], []).append((r["rank"], r["p"]))
    for i, q in enumerate(qs):
        want = [p for _, p in sorted((km(q, x), j) for j, x in enumerate(ps))[:5]]
        have = [p for _, p in sorted(got[i])]
        assert [km(q, ps[p]) for p in have] == pytest.approx([km(q, ps[p]) for p in want], abs=2e-6)


def test_queries_away_from_crowds_need_no_rounds(spark, monkeypatch):
    r = random.Random(5)
    qs, ps = [[(r.uniform(-60, 60), r.uniform(-180, 180)) for _ in range(n)] for n in (40, 200)]
    rounds = []
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: rounds.append(df) or df)
    near = spatial.knn_join(frame(spark, qs, "q"), frame(spark, ps, "p"), 1, query_cols=["q"], point_cols=["p"], tie=["p"]).collect()
    assert not rounds
    assert {(x["q"], x["p"]) for x in near} == {(i, min((km(q, p), j) for j, p in enumerate(ps))[1]) for i, q in enumerate(qs)}


def test_fewer_points_than_k(spark):
    near = spatial.knn_join(frame(spark, [(0.0, 0.0)], "q"), frame(spark, [(80.0, 170.0), (-70.0, 1.0)], "p"), 5, query_cols=["q"], point_cols=["p"])
    assert near.count() == 2


@pytest.mark.parametrize("leaf", [4, 512])
def test_support_join_equals_brute_force(spark, leaf):
    r = random.Random(5)
    qs = [(p, r.uniform(0, 30) * 86400) for p in scattered(3, 80)]
    ps = [(p, r.uniform(0, 30) * 86400) for p in scattered(4, 400)]
    make = lambda rows, key: spark.createDataFrame([(i, p[0], p[1], t) for i, (p, t) in enumerate(rows)], f"{key} int, lat double, lon double, ts double")
    near = spatial.knn_join(make(qs, "q"), make(ps, "p"), 4, query_cols=["q"], point_cols=["p"], tie=["p"], time="ts", window_h=72.0, radius_km=300.0, leaf=leaf)
    got = {}
    for row in near.collect():
        got.setdefault(row["q"], []).append((row["rank"], row["p"]))
    for i, (q, t) in enumerate(qs):
        want = sorted((km(q, p), abs(s - t), j) for j, (p, s) in enumerate(ps) if abs(s - t) <= 72 * 3600 and km(q, p) <= 300)[:4]
        assert [p for _, p in sorted(got.get(i, []))] == [j for *_, j in want]


@pytest.mark.parametrize("few", [False, True])
def test_support_lists_come_from_one_shuffle(spark, monkeypatch, few):
    """Rows, points and results each go through one exchange at most, and homes, chunks and blocks of any size give the same lists."""
    if few:
        for name, n in (("HOME_ROWS", 7), ("CHUNK", 11), ("LEAF", 2), ("PAIRS", 8)):
            monkeypatch.setattr(blocks, name, n)
    r = random.Random(8)
    qs = [(p, r.choice([0.0, 1.0, 2.5, r.uniform(0, 30)]) * 86400) for p in scattered(3, 80)] + [((20.5, -60.5), 86400.0), ((None, 1.0), 0.0), ((1.0, 1.0), None)]
    ps = [(p, r.choice([0.0, 1.0, 4.0, r.uniform(0, 30)]) * 86400) for p in scattered(4, 400)] + [((None, 3.0), 0.0), ((20.5, -60.5), None)]
    make = lambda rows, key: spark.createDataFrame([(i, p[0], p[1], t) for i, (p, t) in enumerate(rows)], f"{key} int, lat double, lon double, ts double")
    near = spatial.support_join(make(qs, "q"), make(ps, "p"), query_cols=["q"], obs_cols=["p"], tie=["p"], radius_km=300.0, limit=4)
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {}
    for row in near.collect():
        got.setdefault(row["q"], []).append((row["rank"], row["p"], row["distance_km"], row["gap_h"]))
    for i, (q, t) in enumerate(qs):
        known = [] if None in (*q, t) else [(j, p, s) for j, (p, s) in enumerate(ps) if None not in (*p, s)]
        want = sorted((km(q, p), abs(s - t), j) for j, p, s in known if abs(s - t) <= 72 * 3600 and km(q, p) <= 300)[:4]
        have = sorted(got.get(i, []))
        assert [x[:2] for x in have] == [(n, w[2]) for n, w in enumerate(want, 1)]
        assert [x[2:] for x in have] == [(pytest.approx(w[0], abs=2e-6), pytest.approx(w[1] / 3600)) for w in want]


@pytest.mark.parametrize("few", [False, True])
def test_gaussian_fields_join_no_rows_and_equal_brute_force(spark, monkeypatch, few):
    if few:
        for name, n in (("HOME_ROWS", 7), ("CHUNK", 11), ("LEAF", 2), ("SUMMED", 8)):
            monkeypatch.setattr(blocks, name, n)
    r = random.Random(9)
    cells, ps = scattered(6, 60), [(p, r.choice(["a", "b", None]), r.choice([None, 0.0, r.gauss(2, 5)]), r.choice([None, r.gauss(0, 1)])) for p in scattered(7, 300)]
    obs = spark.createDataFrame([(p[0], p[1], *rest) for p, *rest in ps] + [(None, 1.0, "a", 1.0, 1.0)], "lat double, lon double, g string, u double, w double")
    out = spatial.gaussian_fields(obs, frame(spark, cells, "c"), ["u", "w"], cell_cols=["c"], by=["g"], length_km=250.0, radius_km=700.0)
    assert "SortMergeJoin [_c0" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x["c"], x["g"]): x for x in out.collect()}
    seen = set()
    for i, c in enumerate(cells):
        for g in ("a", "b", None):
            inside = [(km(c, p), u, w) for p, h, u, w in ps if h == g and (u, w) != (None, None) and km(c, p) <= 700]
            if not inside:
                continue
            seen.add((i, g))
            for name, at in (("u", 1), ("w", 2)):
                own = [(x[0], x[at]) for x in inside if x[at] is not None]
                x = got[i, g]
                assert x[f"{name}_n"] == len(own)
                if own:
                    weights = [math.exp(-((d / 250.0) ** 2)) for d, _ in own]
                    assert x[name] == pytest.approx(sum(a * b for a, (_, b) in zip(weights, own)) / sum(weights), abs=1e-7)
                    assert x[f"{name}_km"] == pytest.approx(min(d for d, _ in own), abs=2e-6)
                else:
                    assert x[name] is None and x[f"{name}_km"] is None
    assert set(got) == seen


def test_radius_pairs_equal_brute_force(spark):
    qs, ps = scattered(6, 100), scattered(7, 200)
    pairs = spatial.radius_pairs(frame(spark, qs, "q"), frame(spark, ps, "p"), 700.0, cell_cols=["q"], point_cols=["p"])
    got = sorted((r["q"], r["p"]) for r in pairs.collect())
    assert got == sorted((i, j) for i, q in enumerate(qs) for j, p in enumerate(ps) if km(q, p) <= 700)


def test_exact_hit_and_missing_neighbours(spark):
    rows = [(1, 0.0, None, 1), (1, 5.0, 3.0, 2), (1, 5.0, 5.0, 3), (2, 0.0, 9.0, 1), (2, 5.0, 1.0, 2), (3, 1.0, None, 1)]
    df = spark.createDataFrame(rows, "o int, distance_km double, v double, rank int")
    got = dict(df.groupBy("o").agg(spatial.idw_aggregate("v").alias("v")).collect())
    assert got == {1: pytest.approx(4.0), 2: 9.0, 3: None}


@pytest.mark.parametrize("half", [1, 4])
def test_neighbourhood_wraps_and_clamps(spark, half):
    nx, ny = 6, 5
    value = {(y, x): None if (y + x) % 4 == 0 else float(y * 10 + x * x) for y in range(ny) for x in range(nx)}
    df = spark.createDataFrame([("d", y, x, v) for (y, x), v in value.items()], "dt string, y int, x int, v double")
    got = {(r["y"], r["x"]): (r["mean_w"], r["std_w"]) for r in grids.neighbourhood_fields(df, "v", {"w": half}, nx=F.lit(nx), ny=F.lit(ny)).collect()}
    for (y, x), (mean, std) in got.items():
        cells = [value[(b, (x + d) % nx)] for b in range(max(y - half, 0), min(y + half, ny - 1) + 1) for d in range(-half, half + 1)]
        vals = [c for c in cells if c is not None]
        if len(vals) < 0.25 * len(cells):
            assert mean is None and std is None
        else:
            m = sum(vals) / len(vals)
            assert mean == pytest.approx(m)
            assert std == pytest.approx(math.sqrt(sum((v - m) ** 2 for v in vals) / len(vals)), abs=1e-6)


def test_spatial_plans_have_no_nested_loops(spark, views):
    near = spatial.knn_cells(views.obs, views.geometry, 8, obs_cols=["obs_id"])
    text = near._jdf.queryExecution().executedPlan().toString()
    pairs = spatial.radius_pairs(views.geometry, views.obs, 300.0, cell_cols=["y", "x"], point_cols=["obs_id"])
    text += pairs._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_multiplied_rows_are_not_sent_whole_through_the_driver(spark):
    """Rows of cubes, days or neighbours are many times their table, which looks small to the planner."""
    cells = spark.range(60).selectExpr("CAST(id AS INT) AS x", "0 AS y", "CAST(id % 50 AS DOUBLE) AS lat", "id*5.0D - 150 AS lon")
    obs = spark.range(60).selectExpr("CAST(id AS INT) AS o", "'d' AS dt", "id % 40 + 0.3D AS lat", "id*5.0D - 149 AS lon")
    days = cells.withColumn("dt", F.explode(F.array(F.lit("d"), F.lit("e")))).withColumn("sst_c", F.lit(1.0))
    near = spatial.knn_cells(obs, cells, 2, obs_cols=["o", "dt"])
    pairs = spatial.radius_pairs(cells, obs, 300.0, cell_cols=["x"], point_cols=["o"])
    mask = spatial.distance_mask(cells, obs, "lat", 300.0, cell_cols=["x"])
    columns = cells.select("y", "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.lit(1.0).alias("t"))
    spread = [near, pairs, spatial.idw_sample(near, days, ["sst_c"], obs_cols=["o"]), profiles.idw_profile(near, columns, ["o"], ["y", "x"], ["t"])]
    for df in spread:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" not in mask._jdf.queryExecution().executedPlan().toString()


def test_surface_statistics_read_the_surface_once(spark):
    """The difference surface hangs on a join of all pairs: the moments, the sketch and the counts must not each make it anew."""
    r = random.Random(5)
    rows = [(i, s, r.choice([-1.5, 0.0, r.gauss(0, 3)])) for s in ("DJF", "JJA") for i in range(101)] + [(200, "DJF", None)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def made(v):
        seen.add(1)
        return v

    diff = spark.createDataFrame(rows, "x int, season string, d double").withColumn("difference", made("d"))
    got = {g["season"]: g for g in grids.surface_statistics(diff, ["season"]).collect()}
    assert seen.value == len(rows)
    assert set(got) == {"DJF", "JJA"}
    for season, g in got.items():
        vals = sorted(d for _, s, d in rows if s == season and d is not None)
        assert (g["cells"], g["min"], g["max"], g["median"]) == (101, vals[0], vals[-1], pytest.approx(vals[50]))
        assert g["mean"] == pytest.approx(sum(vals) / 101) and g["rmse"] == pytest.approx(math.sqrt(sum(v * v for v in vals) / 101))
    whole = grids.surface_statistics(diff).collect()[0]
    assert whole["cells"] == 202 and seen.value == 2 * len(rows)
