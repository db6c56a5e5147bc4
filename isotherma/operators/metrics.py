"""Error metrics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import wrap_lon
from ..functions.labels import named_boxes, patch20, patch_south, patch_west
from .ordered import exact_quantiles, quantile_columns


def _ok(obs: Column, pred: Column) -> Column:
    return obs.isNotNull() & pred.isNotNull()


def metric_columns(obs="obs", pred="pred", date: str | None = "date") -> list[Column]:
    """G1 as aggregates over rows where both values are present."""
    o0, p0 = F.col(obs), F.col(pred)
    ok = _ok(o0, p0)
    o, p = F.when(ok, o0), F.when(ok, p0)
    err = p - o
    n = F.count(err)
    spread = F.var_pop(o) * n
    out = [
        n.alias("rows"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(spread > 1e-12, 1 - F.sum(err * err) / F.when(spread > 1e-12, spread)).alias("r2"), F.avg(err).alias("bias"),
        F.when((n > 1) & (F.stddev_pop(o) > 1e-12) & (F.stddev_pop(p) > 1e-12), F.corr(o, p)).alias("corr"),
        F.when(F.stddev_pop(o) > 1e-12, F.regr_slope(p, o)).alias("slope"),
    ]
    if date is not None:
        out.insert(1, F.countDistinct(F.when(ok, F.col(date))).alias("dates"))
    return out


def error_metrics(df: DataFrame, obs="obs", pred="pred", date: str | None = "date", by: Sequence[str] = (),
                  min_rows: int = 1) -> DataFrame:
    """G1: metrics per group; groups with fewer rows than ``min_rows`` are dropped."""
    return df.groupBy(*by).agg(*metric_columns(obs, pred, date)).where(F.col("rows") >= min_rows)


def predictions_long(df: DataFrame, keep: Sequence[str], models: dict[str, str]) -> DataFrame:
    """One row per observation and model from one column per model."""
    entries = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("pred")) for n, c in models.items()])
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.model", "_e.pred")


def grouped_metrics(long: DataFrame, groupings: Sequence[str], *, fixed: Sequence[str] = ("model",), obs="obs", pred="pred",
                    date: str | None = "date") -> DataFrame:
    """Metrics for each grouping on its own, one long table from a single pass (grouping sets).

    ``subset_kind`` names the grouping and ``subset`` its value.
    """
    cols = [F.col(g).cast("string").alias(g) for g in groupings]
    rest = [c for c in dict.fromkeys([obs, pred, *([date] if date else [])])]
    rows = long.select(*fixed, *cols, *rest)
    if date:
        # A counted distinct and grouping sets both expand rows; counting per date first keeps one expansion.
        rows = rows.withColumnRenamed(date, "_date")
    sets = [[*[F.col(f) for f in fixed], F.col(g)] for g in groupings]
    out = rows.groupingSets(sets, *[F.col(f) for f in fixed], *[F.col(g) for g in groupings]).agg(
        *metric_columns(obs, pred, "_date" if date else None), F.grouping_id().alias("_gid"))
    kind, value = None, None
    n = len(groupings)
    for i, g in enumerate(groupings):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        kind = F.when(F.col("_gid") == gid, g) if kind is None else kind.when(F.col("_gid") == gid, g)
        value = F.when(F.col("_gid") == gid, F.col(g)) if value is None else value.when(F.col("_gid") == gid, F.col(g))
    drop = {"_gid", *groupings}
    return out.select(*fixed, kind.alias("subset_kind"), value.alias("subset"),
                      *[c for c in out.columns if c not in drop and c not in fixed]).where(F.col("rows") > 0)


def oof_summary(long: DataFrame, by: Sequence[str] = ("target", "model"), **kw) -> DataFrame:
    """Pooled metrics over all folds, best first."""
    return error_metrics(long.where(F.col(kw.get("pred", "pred")).isNotNull()), by=by, **kw).orderBy(by[0], "mae", "rmse")


def monthly_summary(pairs: DataFrame, obs="obs_tchp", model="model_tchp", month="month", platform="platform",
                    date="obs_date") -> DataFrame:
    """Monthly counts, means, and delta statistics."""
    rows = pairs.where(_ok(F.col(obs), F.col(model))).withColumn("_d", F.col(obs) - F.col(model))
    base = rows.groupBy(month).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(platform).alias("n_platforms"), F.countDistinct(date).alias("n_dates"),
        F.avg(obs).alias("obs_mean"), F.avg(model).alias("model_mean"), F.avg("_d").alias("mean_delta"),
        F.avg(F.abs("_d")).alias("mae"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"))
    return base.join(quantile_columns(rows, [month], "_d", {"median_delta": 0.5}), month)


def seasonal_summary(pairs: DataFrame, seasons: dict[str, Sequence[int]], obs="obs_tchp", model="model_tchp",
                     month="month") -> DataFrame:
    """Counts and means per named set of months (a month may belong to several)."""
    label = F.array_compact(F.array(*[F.when(F.col(month).isin(*m), F.lit(n)) for n, m in seasons.items()]))
    rows = pairs.where(_ok(F.col(obs), F.col(model))).withColumn("season", F.explode(label))
    return rows.groupBy("season").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(obs).alias("obs_mean"),
                                      F.avg(model).alias("model_mean"), F.avg(F.col(obs) - F.col(model)).alias("mean_delta"))


def delta_statistics(df: DataFrame, by: Sequence[str], obs="obs_tchp", model="model_tchp", date="obs_date") -> DataFrame:
    """Distribution of obs - model per group; the sample deviation of one row is 0."""
    rows = df.where(_ok(F.col(obs), F.col(model))).withColumn("_d", F.col(obs) - F.col(model))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(date).alias("dates"), F.avg("_d").alias("mean"),
        F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("std"), F.avg(F.abs("_d")).alias("mae"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"), F.corr(obs, model).alias("corr"),
        F.min("_d").alias("min"), F.max("_d").alias("max"))
    q = quantile_columns(rows, by, "_d", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return base.join(q, list(by))


def improvement_columns(obs: str, raw: str, corrected: str) -> list[Column]:
    """Raw and corrected errors side by side over rows where all three are present."""
    ok = F.col(obs).isNotNull() & F.col(raw).isNotNull() & F.col(corrected).isNotNull()
    o = F.when(ok, F.col(obs))
    out = [F.count(o).alias("rows")]
    for tag, c in (("raw", raw), ("corrected", corrected)):
        e = F.when(ok, F.col(c)) - o
        out += [F.avg(F.abs(e)).alias(f"{tag}_mae"), F.sqrt(F.avg(e * e)).alias(f"{tag}_rmse"), F.avg(e).alias(f"{tag}_bias"),
                F.corr(o, F.when(ok, F.col(c))).alias(f"{tag}_corr")]
    e0, e1 = F.abs(F.col(raw) - F.col(obs)), F.abs(F.col(corrected) - F.col(obs))
    out.append((F.avg(F.when(ok, e0)) - F.avg(F.when(ok, e1))).alias("mae_improvement"))
    return out


def improvement_by(df: DataFrame, by: Sequence[str], obs: str, raw: str, corrected: str, min_rows: int = 1) -> DataFrame:
    return df.groupBy(*by).agg(*improvement_columns(obs, raw, corrected)).where(F.col("rows") >= min_rows)


def box_stats(df: DataFrame, obs: str, raw: str, corrected: str, deg: int = 20, min_rows: int = 25,
              extra: Sequence[str] = ()) -> DataFrame:
    """Errors per box; small boxes are dropped."""
    rows = df.select("*", patch_south("lat", deg).alias("lat0"), patch_west("lon", deg).alias("lon0"),
                     patch20("lat", "lon", deg).alias("patch"))
    return improvement_by(rows, [*extra, "patch", "lat0", "lon0"], obs, raw, corrected, min_rows)


def support_calendar(df: DataFrame, month="month") -> DataFrame:
    """Casts per named box and month, zeros included."""
    boxes = named_boxes(df.sparkSession)
    calendar = boxes.withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12))))
    rows = df.select(F.col(month).cast("int").alias(month), patch_south("lat").alias("lat0"), patch_west("lon").alias("lon0"))
    counts = rows.groupBy("lat0", "lon0", month).agg(F.count(F.lit(1)).alias("n"))
    out = calendar.join(counts, ["lat0", "lon0", month], "left")
    return out.select("box_key", month, F.coalesce("n", F.lit(0)).alias("n"))


def collocation_summary(df: DataFrame, columns: Sequence[str], date="dt", groupings=("year", "month", "season")) -> DataFrame:
    """Rows, dates and finite counts in total and per year, month and season (grouping sets)."""
    rows = df.select(*[F.col(g).cast("string").alias(g) for g in groupings], date, *columns)
    sets = [[], *[[F.col(g)] for g in groupings]]
    out = rows.groupingSets(sets, *[F.col(g) for g in groupings]).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"),
        *[F.count(c).alias(f"n_{c}") for c in columns], F.grouping_id().alias("_gid"))
    n, kind = len(groupings), F.when(F.col("_gid") == (1 << len(groupings)) - 1, "total")
    for i, g in enumerate(groupings):
        kind = kind.when(F.col("_gid") == (1 << n) - 1 - (1 << (n - 1 - i)), g)
    return out.select(kind.alias("subset_kind"), F.coalesce(*groupings, F.lit("all")).alias("subset"), "rows", "dates",
                      *[f"n_{c}" for c in columns])


def threshold_breakdown(df: DataFrame, cell="cell", obs="obs_tchp", model="model_tchp") -> DataFrame:
    """Counts, share and means per threshold cell."""
    out = df.groupBy(cell).agg(F.count(F.lit(1)).alias("rows"), F.avg(obs).alias("obs_mean"), F.avg(model).alias("model_mean"))
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(0))))


def threshold_by_season(df: DataFrame, cell="cell", season="season") -> DataFrame:
    """Cell by season contingency."""
    out = df.groupBy(cell).pivot(season, ["winter_jfm", "summer_jas", "other"]).count()
    return out.na.fill(0)


def platform_leakage(train: DataFrame, test: DataFrame, platform="platform") -> DataFrame:
    """How much of the test set comes from platforms seen in training."""
    seen = train.select(platform).distinct().withColumn("_train", F.lit(1))
    per_test = test.groupBy(platform).agg(F.count(F.lit(1)).alias("_rows"))
    both = seen.join(per_test, platform, "full").agg(
        F.count("_train").alias("train_platforms"), F.count("_rows").alias("test_platforms"),
        F.count(F.when(F.col("_train").isNotNull() & F.col("_rows").isNotNull(), 1)).alias("overlap_platforms"),
        F.sum("_rows").alias("test_rows"),
        F.sum(F.when(F.col("_train").isNotNull(), F.col("_rows")).otherwise(0)).alias("test_rows_seen"))
    return both.select("*", (F.col("overlap_platforms") / F.col("test_platforms")).alias("platform_share"),
                       (F.col("test_rows_seen") / F.col("test_rows")).alias("row_share"))


def platform_distances(test: DataFrame, support: DataFrame, key="cast_id") -> DataFrame:
    """Rows per test year with a training profile of the same platform, and the median and 90 % distance to it."""
    rows = test.select(key, "year").join(support.select(key, "support_km"), key)
    counts = rows.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(quantile_columns(rows, ["year"], "support_km", {"median_km": 0.5, "p90_km": 0.9}), "year")


def _edge_array(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct equal-quantile edges: ``bins`` + 1 numbers at most."""
    q = exact_quantiles(df, [], value, [i / bins for i in range(bins + 1)])
    return sorted({r["quantile"] for r in q.collect()})


def _bin_index(value: str, edges: Sequence[float], right_closed: bool) -> Column:
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (F.col(value) > e if right_closed else F.col(value) >= e).cast("int")
    return out


def quantile_bin_mae(df: DataFrame, feature: str, raw_abs: str, corr_abs: str, q: int = 10) -> DataFrame:
    """Errors per quantile bin of a feature; bins are right-closed, equal edges merge."""
    rows = df.where(F.col(feature).isNotNull() & F.col(raw_abs).isNotNull() & F.col(corr_abs).isNotNull())
    edges = _edge_array(rows, feature, q)
    rows = rows.withColumn("bin", _bin_index(feature, edges, True))
    base = rows.groupBy("bin").agg(F.avg(raw_abs).alias("raw_mae"), F.avg(corr_abs).alias("corrected_mae"),
                                   F.count(F.lit(1)).alias("rows"))
    return base.join(quantile_columns(rows, ["bin"], feature, {"bin_center": 0.5}), "bin").drop("bin")


def conditional_skill(df: DataFrame, obs: str, raw: str, corrected: str, bins: int = 12, min_rows: int = 40) -> DataFrame:
    """Raw and corrected errors per equal-quantile bin of the observed value; left-closed, last bin closed."""
    rows = df.where(F.col(obs).isNotNull() & F.col(raw).isNotNull() & F.col(corrected).isNotNull())
    edges = _edge_array(rows, obs, bins)
    rows = rows.withColumn("bin", _bin_index(obs, edges, False))
    e0, e1 = F.col(raw) - F.col(obs), F.col(corrected) - F.col(obs)
    out = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e0)).alias("mae_raw"), F.avg(F.abs(e1)).alias("mae_corrected"),
        F.avg(e0).alias("bias_raw"), F.avg(e1).alias("bias_corrected")).where(F.col("rows") >= min_rows)
    lits = F.array(*[F.lit(float(e)) for e in edges])
    out = out.join(quantile_columns(rows, ["bin"], obs, {"bin_center": 0.5}), "bin")
    return out.select("bin", F.get(lits, F.col("bin")).alias("bin_lo"), F.get(lits, F.col("bin") + 1).alias("bin_hi"),
                      "bin_center", "rows", "mae_raw", "mae_corrected", "bias_raw", "bias_corrected",
                      (F.col("mae_raw") - F.col("mae_corrected")).alias("mae_improvement"))


def skill_crossover(skill: DataFrame) -> DataFrame:
    """Lower edge of the last bin where the improvement turns negative (bins are few by construction)."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    rows = skill.withColumn("_before", F.lag("mae_improvement").over(w))
    turned = (F.col("mae_improvement") < 0) & (F.col("_before") >= 0)
    return rows.agg(F.max(F.when(turned, F.col("bin_lo"))).alias("crossover"))


def worst_bin(skill: DataFrame) -> DataFrame:
    """The bin with the lowest improvement."""
    return skill.agg(F.min_by(F.struct("bin", "bin_lo", "bin_hi", "mae_improvement"), F.struct("mae_improvement", "bin")).alias("w")).select("w.*")


def threshold_sweep(df: DataFrame, obs: str, models: dict[str, str], steps: Sequence[float], min_rows: int = 40) -> DataFrame:
    """Errors over rows at or above each threshold, up to the first threshold with too few rows.

    Each row is counted once, in the highest threshold it reaches; the sums of the higher thresholds are added
    afterwards, so rows are not copied per threshold.
    """
    steps = sorted(float(s) for s in steps)
    band = F.lit(-1)
    for s in steps:
        band = band + (F.col(obs) >= s).cast("int")
    rows = predictions_long(df.where(F.col(obs).isNotNull()), [obs], models).where(F.col("pred").isNotNull())
    err = F.col("pred") - F.col(obs)
    sums = rows.withColumn("band", band).where("band >= 0").groupBy("model", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("a"), F.sum(err).alias("b"))
    # Every threshold has a row, also one no observation stops at.
    frame = rows.sparkSession.createDataFrame([(m, i, s) for m in models for i, s in enumerate(steps)],
                                              "model string, band int, threshold double")
    full = frame.join(sums, ["model", "band"], "left")
    up = Window.partitionBy("model").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.select("model", "band", "threshold", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("rows"),
                       F.sum("a").over(up).alias("a"), F.sum("b").over(up).alias("b"))
    # Counts fall with the threshold, so the first short one stops the sweep.
    return full.where(F.col("rows") >= min_rows).select("model", "threshold", "rows", (F.col("a") / F.col("rows")).alias("mae"),
                                                        (F.col("b") / F.col("rows")).alias("bias"))


def threshold_by_box(df: DataFrame, obs: str, models: dict[str, str], critical: float, min_rows: int = 25) -> DataFrame:
    """Errors above the critical value per named box; too few rows give NULL errors."""
    boxes = named_boxes(df.sparkSession).select("box_key", "lat0", "lon0")
    rows = df.where(F.col(obs) >= critical).select("*", (F.floor(F.col("lat") / 20) * 20).cast("int").alias("lat0"),
                                                   (F.floor(wrap_lon("lon") / 20) * 20).cast("int").alias("lon0"))
    rows = predictions_long(rows, ["lat0", "lon0", obs], models).where(F.col("pred").isNotNull())
    err = F.col("pred") - F.col(obs)
    stats = rows.groupBy("lat0", "lon0", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("a"), F.avg(err).alias("b"))
    frame = boxes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out = frame.join(stats, ["lat0", "lon0", "model"], "left").withColumn("rows", F.coalesce("n", F.lit(0)))
    enough = F.col("rows") >= min_rows
    return out.select("model", "box_key", "rows", F.when(enough, F.col("a")).alias("mae"), F.when(enough, F.col("b")).alias("bias"))


def validate_product(df: DataFrame, key="cast_id") -> DataFrame:
    """Nine anomaly counts of a product table."""
    ok = df.where(F.col("error").isNull()) if "error" in df.columns else df
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    d26, tchp, sst = F.col("d26_m"), F.col("tchp_kj_per_cm2"), F.col("surface_t_c")
    counts = ok.agg(
        F.count(F.lit(1)).alias("rows_ok"), flag(d26 < 0).alias("negative_d26"), flag(d26 > F.col("max_depth_m")).alias("d26_gt_max_depth"),
        flag(tchp < 0).alias("negative_tchp"), flag(F.col("ohc_j_per_m2") < 0).alias("negative_ohc"),
        flag((sst < 26) & (tchp > 0)).alias("cold_surface_positive_tchp"),
        flag((sst >= 26) & d26.isNull()).alias("warm_surface_missing_d26"))
    repeated = ok.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return counts.select(total.scalar().alias("rows_total"), "*", repeated.scalar().alias("duplicate_cast_ids"))


QUANTILES = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)


def product_quantiles(df: DataFrame, columns: Sequence[str] = ("tchp_kj_per_cm2", "d26_m"), probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles of the product's values, of the rows without an error: ``(column_name, prob, quantile)``."""
    ok = df.where(F.col("error").isNull()) if "error" in df.columns else df
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = ok.select(F.explode(entries).alias("_e")).select("_e.*")
    return exact_quantiles(long, ["column_name"], "value", probs)


def suspicious_rows(df: DataFrame) -> DataFrame:
    """Rows that break an invariant."""
    d26, tchp, sst = F.col("d26_m"), F.col("tchp_kj_per_cm2"), F.col("surface_t_c")
    return df.where((d26 < 0) | ((sst < 26) & (tchp > 0)) | ((sst >= 26) & d26.isNull()))


def fixed_draw(rep: str, slot: str, size: str, xor=lambda a, b: f"({a} ^ {b})", div="div") -> str:
    """SQL of a fixed pseudo-random draw in 0..size-1: two rounds of multiply and fold on 32 bits."""
    h = f"((({rep} * 1000003 + {slot} + 1) * 1540483477) % 4294967296)"
    h = f"(({xor(h, f'({h} {div} 65536)')} * 1540483477) % 4294967296)"
    return f"({xor(h, f'({h} {div} 32768)')} % {size})"


def cluster_bootstrap_ci(df: DataFrame, obs: str, pred: str, date: str, reps: int = 1000) -> DataFrame:
    """Percentile intervals of MAE, RMSE and |bias| over dates resampled with replacement.

    Draws follow a fixed rule, so a run can be repeated. Only per-date sums are resampled: a replicate's metric is a ratio
    of sums of its dates. Replicates are generated from each date, so nothing is crossed.
    """
    err = F.col(pred) - F.col(obs)
    rows = df.where(F.col(pred).isNotNull() & F.col(obs).isNotNull())
    per_date = rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("a"), F.sum(err).alias("b"),
                                      F.sum(err * err).alias("c"))
    # Distinct dates are a calendar: bounded by days, not by rows.
    per_date = per_date.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    # Slot i of a replicate draws one date; a replicate has as many slots as there are dates.
    draws = per_date.select(F.col("_m").cast("long").alias("m"), F.col("i").cast("long").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    draws = draws.select("rep", F.expr(fixed_draw("rep", "slot", "m")).cast("int").alias("i"))
    weights = draws.groupBy("rep", "i").agg(F.count(F.lit(1)).alias("w"))
    boot = weights.join(per_date.select("i", "n", "a", "b", "c"), "i").groupBy("rep").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "a", "b", "c")])
    as_metrics = lambda d: d.select(F.explode(F.array(
        F.struct(F.lit("mae").alias("metric"), (F.col("a") / F.col("n")).alias("v")),
        F.struct(F.lit("rmse").alias("metric"), F.sqrt(F.col("c") / F.col("n")).alias("v")),
        F.struct(F.lit("abs_bias").alias("metric"), F.abs(F.col("b") / F.col("n")).alias("v")))).alias("e")).select("e.*")
    # ``reps`` values per metric: the built-in percentile is bounded here.
    ci = as_metrics(boot).groupBy("metric").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))
    point = as_metrics(per_date.agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "c")])).withColumnRenamed("v", "point")
    return point.join(ci, "metric")


def raw_bias_comparison(datasets: dict[str, DataFrame], obs: str, model: str, min_rows: int = 10) -> DataFrame:
    """Bias, MAE and correlation by dataset, overall and per named box."""
    parts = [d.select("lat", "lon", obs, model).withColumn("dataset", F.lit(n)) for n, d in datasets.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    boxes = F.broadcast(named_boxes(rows.sparkSession).select("box_key", "lat0", "lon0"))  # eight rows
    rows = rows.withColumn("lat0", patch_south("lat")).withColumn("lon0", patch_west("lon")).join(boxes, ["lat0", "lon0"], "left")
    scopes = F.array_compact(F.array(F.lit("global"), F.col("box_key")))
    return error_metrics(rows.withColumn("scope", F.explode(scopes)), obs, model, None, ["dataset", "scope"], min_rows)


def track_summary(track: DataFrame, by: Sequence[str], pad_deg: float = 5.0, time="iso_time") -> DataFrame:
    """Padded box, dates and peaks of each track."""
    num = lambda c: F.col(c).try_cast("double") if dict(track.dtypes)[c] == "string" else F.col(c)
    return track.groupBy(*by).agg(
        (F.min("lat") - pad_deg).alias("south"), (F.max("lat") + pad_deg).alias("north"), (F.min("lon") - pad_deg).alias("west"),
        (F.max("lon") + pad_deg).alias("east"), F.countDistinct(F.to_date(time)).alias("dates"),
        F.max(num("usa_wind")).alias("peak_wind"), F.max(num("usa_sshs")).alias("peak_category"))


def top_dates(df: DataFrame, n: int = 5, month="month", date="obs_date") -> DataFrame:
    """The ``n`` busiest dates of each month, ties by date."""
    counts = df.groupBy(month, date).agg(F.count(F.lit(1)).alias("casts"))
    w = Window.partitionBy(month).orderBy(F.desc("casts"), date)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ablation_increments(results: DataFrame, steps: Sequence[str], by=("target", "split")) -> DataFrame:
    """MAE per feature set side by side, and the gain of each step."""
    wide = results.groupBy(*by).pivot("feature_set", list(steps)).agg(F.first("mae"))
    gains = [(F.col(a) - F.col(b)).alias(f"gain_{b}") for a, b in zip(steps, steps[1:])]
    return wide.select("*", *gains)


def layer_summary(points: DataFrame, value: str, by: Sequence[str] = ("dt",)) -> DataFrame:
    """Count and range of exported points."""
    return points.groupBy(*by).agg(F.count(value).alias("point_count"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))


def scope_inventory(df: DataFrame, sources: dict[str, DataFrame], date="dt", groupings=("year", "season")) -> DataFrame:
    """Rows and dates of the table, per grouping, that each source also covers."""
    parts = []
    for name, source in sources.items():
        covered = df.join(source.select(date).distinct(), date, "left_semi").withColumn("source", F.lit(name))
        parts.append(covered.select("source", date, *[F.col(g).cast("string").alias(g) for g in groupings]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kinds = F.array(*[F.struct(F.lit(g).alias("subset_kind"), F.col(g).alias("subset")) for g in groupings])
    rows = rows.select("source", date, F.explode(kinds).alias("_e")).select("source", date, "_e.*")
    return rows.groupBy("source", "subset_kind", "subset").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"))


def replay_metadata(pairs: DataFrame, grid: DataFrame, date="dt", platform="platform") -> DataFrame:
    """Pair and platform counts and the dates a replay can show (the last is the default)."""
    dates = grid.select(date).distinct().join(pairs.select(date).distinct(), date, "left_semi")
    span = dates.agg(F.count(F.lit(1)).alias("n_dates"), F.min(date).cast("string").alias("first_date"),
                     F.max(date).cast("string").alias("default_date"),
                     F.array_join(F.sort_array(F.collect_list(F.col(date).cast("string"))), ",").alias("dates"))  # a calendar's length
    counts = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(platform).alias("n_platforms"))
    return counts.select("*", span.select(F.struct("*")).scalar().alias("_s")).select("n_pairs", "n_platforms", "_s.*")


def availability_matrix(df: DataFrame, column: str, years: Sequence[int], year="year", month="month") -> DataFrame:
    """Share of finite values per year and month; NULL for a month without rows."""
    stats = df.groupBy(F.col(year).cast("int").alias(year), F.col(month).cast("int").alias(month)).agg(
        F.count(F.lit(1)).alias("rows"), F.count(column).alias("n_finite"))
    frame = df.sparkSession.createDataFrame([(int(y), m) for y in years for m in range(1, 13)], f"{year} int, {month} int")
    out = frame.join(stats, [year, month], "left")
    return out.select(year, month, F.coalesce("n_finite", F.lit(0)).alias("n_finite"),
                      F.coalesce(F.col("rows") - F.col("n_finite"), F.lit(0)).alias("n_missing"),
                      (F.col("n_finite") / F.col("rows")).alias("share"))


def top_patches(patches: DataFrame, region: str, k: int) -> DataFrame:
    """Best-supported patches per region, by rows and then improvement."""
    w = Window.partitionBy(region).orderBy(F.desc("rows"), F.desc("mae_improvement"), "patch")
    return patches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
