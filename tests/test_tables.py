"""Sources, sinks, streams, splits, models and table joins."""

import json
import re

import pytest
from pyspark.sql import functions as F

from isotherma import functions as fn
from isotherma.operators import filters, joins, metrics, models, recipes, splits
from isotherma.sources import readers, writers
from isotherma.streaming.incremental import append_stream


def test_read_pairs_fills_the_event(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("cast_id,platform,obs_time,obs_date,lat,lon,obs_tchp_kj_cm2\nc1,77,2024-10-07T00:00:00Z,20241007,20.5,-90,55.5\nc2,78,x,20241008,nan,1,\n")
    rows = readers.read_pairs(spark, str(f), "MILTON_2024").orderBy("cast_id").collect()
    assert [(r["storm_name"], r["storm_season"], r["obs_date"]) for r in rows] == [("MILTON", 2024, "20241007"), ("MILTON", 2024, "20241008")]
    assert rows[0]["obs_tchp_kj_cm2"] == 55.5 and rows[1]["lat"] is None


def test_read_track_drops_the_units_row(spark, tmp_path):
    head = ",".join(readers.TRACK_COLUMNS)
    units = ",".join("degrees_north" if c == "latitude" else " " for c in readers.TRACK_COLUMNS)
    row = ",".join({"latitude": "20.1", "longitude": "-88.0", "iso_time": "2024-10-07 06:00:00", "usa_wind": "90"}.get(c, "x") for c in readers.TRACK_COLUMNS)
    f = tmp_path / "t.csv"
    f.write_text("\n".join([head, units, row]) + "\n")
    rows = readers.read_track(spark, str(f)).collect()
    assert len(rows) == 1 and rows[0]["lat"] == 20.1 and rows[0]["iso_time"].hour == 6


def test_read_cast_index(spark, tmp_path):
    f = tmp_path / "i.txt"
    f.write_text("# title\n# more\nfile,date,latitude,longitude\naoml/13857/profiles/a.nc,20240101,1.5,2.5\naoml/9/profiles/b.nc,20240101,,2.5\nshort\n")
    rows = readers.read_cast_index(spark, str(f)).collect()
    assert [(r["platform"], r["lat"], r["lon"]) for r in rows] == [("13857", 1.5, 2.5)]


def test_write_read_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 2024, 1.0, None), ("b", 2025, 2.0, "broken")], "cast_id string, year int, v double, error string")
    writers.write_product(df, str(tmp_path / "p"))
    got = readers.read_observations(spark, str(tmp_path / "p/parquet"), ["cast_id", "v"], years=[2024, 2025])
    assert [r["cast_id"] for r in got.collect()] == ["a"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in plan and "IsNull(error)" in plan
    target = str(tmp_path / "t")
    for _ in range(2):
        writers.append_new(df, target, "cast_id")
    writers.append_new(df.withColumn("cast_id", F.concat("cast_id", F.lit("x"))), target, "cast_id")
    assert spark.read.parquet(target).count() == 4


def test_append_stream_skips_known_keys(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    for extra in (0, 10):
        df.withColumn("v", F.col("v") + extra).write.mode("append").parquet(src)
        append_stream(spark, src, df.schema, "k", out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_layer_document(spark, tmp_path):
    pts = spark.createDataFrame([("2024-10-07", "tchp", 1.0, 2.0, 5.0), ("2024-10-07", "tchp", 0.0, 2.0, 7.0)], "dt string, layer string, lat double, lon double, value double")
    doc = json.loads(writers.layer_documents(pts, 10, [-100, 0, -50, 40]).collect()[0]["document"])
    assert doc["point_count"] == 2 and doc["value_max"] == 7.0 and doc["points"][0]["lat"] == 0.0 and doc["stride"] == 10
    writers.export_layer(pts, str(tmp_path / "layers"), 10)
    assert spark.read.text(str(tmp_path / "layers")).count() == 1


def test_scalar_edges(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(fn.wrap_lon(F.lit(190.0))) == -170.0 and get(fn.wrap_lon(F.lit(180.0))) == -180.0
    assert get(fn.patch20(F.lit(90.0), F.lit(180.0))) == "lat[80,100) lon[-180,-160)"
    assert get(fn.safe_float(F.lit("inf"))) is None and get(fn.safe_float(F.lit("nan"))) is None and get(fn.safe_float(F.lit("1e3"))) == 1000.0
    assert get(fn.round_half_even(F.lit(0.125), 2)) == 0.12 and get(fn.round_half_even(F.lit(2.5), 0)) == 2.0
    assert get(fn.units_of(F.lit("model_tchp_kj_per_cm2"))) == "kJ/cm²" and get(fn.units_of(F.lit("lat"))) == "°"
    assert get(fn.region_5(F.lit(None).cast("double"), F.lit(0.0))) == "unknown"
    assert get(fn.canonical_date(F.lit("junk"))) is None and get(fn.canonical_date(F.lit("20241007"))) == "2024-10-07"
    with pytest.raises(ValueError):
        filters.season_months("monsoon")


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert filters.require_columns(df, ["a"]) == ["a"]
    assert filters.require_columns(df, ["a", "c"], optional=["c"]) is None
    with pytest.raises(ValueError):
        filters.require_columns(df, ["a", "c"])


def test_alignment_errors(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, lat double")
    for bad in ([(1, 1.0, 5)], [(1, 1.0, 5), (2, 9.0, 6)], [(1, 1.0, 5), (1, 1.0, 5), (2, 2.0, 6)]):
        with pytest.raises(joins.AlignmentError):
            joins.align_tables(base, [spark.createDataFrame(bad, "k int, lat double, f int")], "k", ["lat"])
    with pytest.raises(joins.AlignmentError):
        joins.occurrence_join(base.withColumn("r", F.col("k")), base.where("k = 1").withColumn("s", F.col("k")), ["lat"], "r", "s")


def test_forward_bounds():
    assert splits.forward_bounds(57) == [(1, 20, 21, 33), (2, 33, 34, 46), (3, 46, 47, 57)]
    with pytest.raises(ValueError):
        splits.forward_bounds(19)
    for n in range(20, 400, 7):
        for fold, train_end, start, end in splits.forward_bounds(n):
            assert train_end < start < end <= n  # at least one embargo date


def test_group_folds_never_split_a_group(spark, views):
    roles = splits.group_roles(views.casts, "platform", 5)
    assert roles.groupBy("platform").agg(F.sum((F.col("role") == "validation").cast("int")).alias("n")).where("n <> 1").count() == 0
    sizes = [r[0] for r in splits.group_folds(views.casts, "platform", 5).groupBy("fold").agg(F.sum("rows")).select("sum(rows)").collect()]
    assert max(sizes) - min(sizes) <= 30


def test_bootstrap_point_equals_metrics(spark, views):
    ci = {r["metric"]: r for r in metrics.cluster_bootstrap_ci(views.casts, "obs_tchp", "model_tchp", "obs_date", 50).collect()}
    m = metrics.error_metrics(views.casts, "obs_tchp", "model_tchp", "obs_date").first()
    assert ci["mae"]["point"] == pytest.approx(m["mae"]) and ci["rmse"]["point"] == pytest.approx(m["rmse"])
    assert ci["mae"]["lo"] < ci["mae"]["point"] < ci["mae"]["hi"]


def test_recipes():
    for target in ("tchp", "d26"):
        sets = recipes.recipes(target)
        assert len(sets) == 11 and all(len(set(c)) == len(c) for c in sets.values())
    ladder = list(recipes.geography_ladder(["a"]).values())
    assert all(set(a) < set(b) for a, b in zip(ladder, ladder[1:]))


def small_table(views):
    return views.casts.where("obs_tchp IS NOT NULL AND model_tchp IS NOT NULL").withColumn("ord", F.col("obs_date"))


def test_oof_has_no_leak_and_adds_the_base(spark, views):
    rows = small_table(views)
    roles = splits.forward_folds(rows, "obs_date").cache()
    leak = roles.where("role = 'train'").alias("a").join(roles.where("role = 'validation'").alias("b"), ["obs_date", "fold"])
    assert leak.count() == 0
    oof = models.oof_predict(rows.withColumn("obs_tchp", F.col("model_tchp") + 2.0), roles, "obs_date", ["ssh_m", "mlt_m"], lambda train: models.ridge_delta(train, "obs_tchp", "model_tchp"), obs="obs_tchp", base="model_tchp")
    assert oof.where(F.abs(F.col("pred") - F.col("model_tchp") - 2.0) > 1e-6).count() == 0
    assert oof.count() == rows.join(roles.where("role = 'validation'"), "obs_date").count()


def test_bundle_round_trip(spark, views, tmp_path):
    rows = small_table(views)
    feats = ["lat", "model_tchp", "sst_c"]
    quick = lambda **kw: models.boosted_delta(trees=2, depth=2, **kw)
    model = models.fit_delta(rows, feats, quick(), "obs_tchp", "model_tchp")
    models.freeze_bundle(model, rows, str(tmp_path / "b"), features=feats, obs="obs_tchp")
    again, meta = models.load_bundle(spark, str(tmp_path / "b"))
    assert meta.first()["rows"] == rows.count()
    a = models.predict_delta(model, rows, feats, "model_tchp").agg(F.sum("pred")).first()[0]
    assert models.predict_delta(again, rows, feats, "model_tchp").agg(F.sum("pred")).first()[0] == pytest.approx(a)


def test_bootstrap_and_windows_of_the_reference_are_registered():
    from isotherma.plans import CATALOG

    assert "range(1000)" in CATALOG["g29_cluster_bootstrap_ci_1000"].sql
    wide = CATALOG["j12_neighbourhood_wide"]
    assert {f"{f}_{s}_{n}" for f in ("tchp", "d26", "sst_c") for s in ("mean", "std") for n in ("05deg", "1deg", "2deg")} < set(wide.numbers)
    assert all(f"range(-{h}, {h + 1})" in wide.sql for h in (6, 12, 25))


def test_groups_go_to_the_lightest_fold():
    import collections
    import random

    from isotherma.operators.splits import lightest_runs

    rng = random.Random(3)
    for k in (2, 3, 5, 8):
        for _ in range(60):
            groups = sorted((rng.choice([1, 1, 2, 3, 7, 40, 41, 500]) for _ in range(rng.randint(k, 120))), reverse=True)
            loads, want = [0] * k, []
            for rows in groups:
                fold = loads.index(min(loads))
                loads[fold] += rows
                want.append(fold)
            runs = lightest_runs(sorted(collections.Counter(groups).items(), reverse=True), k)
            begin = {start: folds for _, own in runs for start, folds in own}
            got, at = [], 0
            for i in range(len(groups)):
                at = i if i in begin else at
                got.append(begin[at][(i - at) % len(begin[at])])
            assert got == want


def test_one_column_or_many_make_the_same_exchanges(views):
    """The plan does not grow with the features."""
    from isotherma.operators.diagnostics import correlation_table

    def exchanges(features):
        return correlation_table(views.casts, features, "obs_tchp")._jdf.queryExecution().sparkPlan().toString().count("Join")

    assert exchanges(["ssh_m"]) == exchanges(["ssh_m", "mlt_m", "sst_c", "model_tchp"])


def test_append_reads_the_buckets_of_its_batch_only(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    writers.append_new(df, target, "k")
    known = writers.known_keys(spark, target, "k", [3])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*key_bucket", plan)
    writers.append_new(df.limit(5).withColumn("v", F.lit(2)), target, "k")  # as after a failure
    assert spark.read.parquet(target).agg(F.count("*"), F.sum("v")).first() == (2000, 2000)


def test_profile_store_is_joined_without_a_shuffle(spark, tmp_path):
    levels = spark.createDataFrame([(i, float(z), 30.0 - z / 10) for i in range(40) for z in (0, 20, 40, 60)] + [(50, 0.0, 20.0), (50, 9.0, 19.0)], "cast_id long, depth_m double, temp_c double")
    pairs = spark.createDataFrame([(i, 0.5 * i if i % 2 else None) for i in range(0, 60, 5)] + [(3, -1e9)], "cast_id long, predicted_delta double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keep = lambda df, name: writers.write_bucketed(df, f"t_{name}", str(tmp_path / name), "cast_id", 8)
        observed, model, scalars = keep(levels, "seen"), keep(levels, "model"), keep(joins.profile_scalars(pairs, levels, levels), "scalars")
        out = joins.profile_lookup(scalars, observed, model)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets
        one = scalars.where("cast_id = 3")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in one
        got = {(r["cast_id"], r["profile"], r["depth_m"]): r["temp_c"] for r in out.collect()}
        facts = {r["cast_id"]: r for r in scalars.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for name in ("seen", "model", "scalars"):
            spark.sql(f"DROP TABLE IF EXISTS t_{name}")
    assert facts[5]["correction_source"] == "ml_correction" and facts[10]["correction_source"] == "raw" and facts[10]["correction_delta_kj_cm2"] is None
    assert facts[55]["model_tchp_kj_cm2"] is None and facts[50]["model_tchp_kj_cm2"] is None and facts[55]["correction_source"] == "raw"
    factor = facts[5]["corrected_tchp_kj_cm2"] / facts[5]["model_tchp_kj_cm2"]
    assert got[5, "corrected", 0.0] == pytest.approx(26 + 4 * factor) and got[5, "corrected", 60.0] == got[5, "model", 60.0] == 24.0
    assert got[10, "corrected", 0.0] == got[10, "observed", 0.0] == 30.0
    assert facts[3]["corrected_tchp_kj_cm2"] == 0.0 and got[3, "corrected", 0.0] == 26.0  # not below 0
    assert got[50, "corrected", 0.0] == 20.0 and not any(k[0] == 55 for k in got)
