"""Table joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import planar_deg2
from ..functions.numbers import corrected_temperature
from .filters import in_bbox
from .ordered import running_counts


class AlignmentError(ValueError):
    """Two tables that must match row by row do not."""


def with_occurrence(df: DataFrame, keys: Sequence[str], order: str, out: str = "occurrence") -> DataFrame:
    """0-based counter of a row among the rows with the same keys, by a unique numeric order column.

    Counted by segments of the order column, so a key held by many rows is not sorted in one task.
    """
    counts = running_counts(df, keys, order).select(*keys, order, F.col("before").cast("long").alias(out))
    same = F.lit(True)
    a, b = df.alias("a"), counts.alias("b")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same & (F.col(f"a.{order}") == F.col(f"b.{order}"))).select("a.*", f"b.{out}")


def occurrence_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str,
                    check: bool = True) -> DataFrame:
    """1:1 join of tables without a unique key, by key and occurrence. Rows without a partner are an error."""
    a = with_occurrence(left, keys, left_order)
    b = with_occurrence(right, keys, right_order)
    on = [*keys, "occurrence"]
    if check:
        lonely = a.select(*on).join(b.select(*on), on, "left_anti")
        if not lonely.isEmpty() or not b.select(*on).join(a.select(*on), on, "left_anti").isEmpty():
            raise AlignmentError("occurrence join is not 1:1")
    return a.join(b, on)


def align_tables(base: DataFrame, extras: Sequence[DataFrame], key: str, same: Sequence[str] = ()) -> DataFrame:
    """Widen ``base`` by the new columns of each extra table; keys and shared values must agree."""
    out = base
    for extra in extras:
        if not extra.groupBy(key).count().where("count > 1").isEmpty():
            raise AlignmentError(f"{key} repeats in a feature table")
        pair = base.select(key, *same).join(extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in same],
                                                         F.lit(True).alias("_there")), key, "full")
        differs = F.col("_there").isNull()
        for c in same:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_x_{c}"))
        if not pair.where(differs).isEmpty():
            raise AlignmentError("feature table does not align with the base table")
        new = [c for c in extra.columns if c not in out.columns]
        out = out.join(extra.select(key, *new), key)
    return out


def join_predictions(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions of two targets on their shared columns."""
    return left.join(right, list(on), "inner")


def restrict_to_dates(df: DataFrame, other: DataFrame, date: str = "dt") -> DataFrame:
    """Rows whose date the other source has."""
    return df.join(other.select(date).distinct(), date, "left_semi")


def skip_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not written yet."""
    return df.join(done.select(key), key, "left_anti")


def climatology_cell(coord, origin: float, rule: str = "nearest", step: float = 1.0, n: int | None = None) -> Column:
    """Index of the climatology cell whose centres start at ``origin``.

    ``ceil`` takes the first centre at or above the coordinate; ``nearest`` the closest one. Both clamp.
    """
    c = F.col(coord) if isinstance(coord, str) else coord
    pos = (c - origin) / step
    index = F.ceil(pos) if rule == "ceil" else F.floor(pos + 0.5)
    index = F.greatest(index, F.lit(0))
    return (index if n is None else F.least(index, F.lit(n - 1))).cast("int")


def climatology_lookup(obs: DataFrame, clim: DataFrame, values: Sequence[str], *, origin=(-89.5, -179.5), shape=(180, 360),
                       rule: str = "nearest", month="month") -> DataFrame:
    """Climatology of the month and cell; ``clim`` has month, ``ilat``, ``ilon``."""
    rows = obs.withColumn("ilat", climatology_cell("lat", origin[0], rule, n=shape[0])).withColumn(
        "ilon", climatology_cell("lon", origin[1], rule, n=shape[1]))
    return rows.join(clim.select(month, "ilat", "ilon", *values), [month, "ilat", "ilon"], "left")


SIDES = ("obs", "model")
RAW_SOURCE = "raw"


def profile_scalars(pairs: DataFrame, observed: DataFrame, model: DataFrame, *, key="cast_id", delta="predicted_delta", source: str = "ml_correction",
                    z="depth_m", t="temp_c") -> DataFrame:
    """Scalars of the casts of ``pairs``: heat content, isotherm and surface temperature of both profiles, and the learned correction.

    ``delta`` is the prediction of a correction model, NULL where there is none; then, or without modelled heat content, the source is ``raw`` and the
    modelled heat content stays as it is. Corrected heat content is not below 0. Casts without a profile on a side have NULL there.
    """
    from .profiles import heat_excess_trapezoid

    rows = pairs
    for side, levels in zip(SIDES, (observed, model)):
        own = levels.join(pairs.select(key), key, "left_semi")
        heat = heat_excess_trapezoid(own, [key], z, t).select(key, F.col("tchp_kj_per_cm2").alias(f"{side}_tchp_kj_cm2"), F.col("d26_m").alias(f"{side}_d26_m"),
                                                              F.col("surface_temp_c").alias(f"{side}_surface_t_c"))
        rows = rows.join(heat, key, "left")
    known = F.col(delta).isNotNull() & F.col("model_tchp_kj_cm2").isNotNull()
    return rows.select(
        *pairs.drop(delta).columns, *[f"{side}_{c}" for side in SIDES for c in ("tchp_kj_cm2", "d26_m", "surface_t_c")],
        F.when(known, F.col(delta)).alias("correction_delta_kj_cm2"), F.when(known, source).otherwise(RAW_SOURCE).alias("correction_source"),
        F.when(known, F.greatest(F.lit(0.0), F.col("model_tchp_kj_cm2") + F.col(delta))).otherwise(F.col("model_tchp_kj_cm2")).alias("corrected_tchp_kj_cm2"),
        (F.col("obs_tchp_kj_cm2") - F.col("model_tchp_kj_cm2")).alias("delta_tchp_kj_cm2"))


def profile_lookup(scalars: DataFrame, observed: DataFrame, model: DataFrame, *, key="cast_id", z="depth_m", t="temp_c", keep: Sequence[str] = ()) -> DataFrame:
    """The levels of the observed, the modelled and the corrected profile of the casts of ``scalars``: (key, profile, z, t, keep).

    The corrected profile is the modelled one with its part above the isotherm scaled to the corrected heat content, if that is known and the
    modelled one is above 0. One row per level, so a long profile is no single value. Tables stored by ``writers.write_bucketed`` on
    the key are joined without a shuffle.
    """
    columns = [key, z, t, *keep]
    raw, corrected = F.col("model_tchp_kj_cm2"), F.col("corrected_tchp_kj_cm2")
    seen = observed.select(*columns).join(scalars.select(key), key, "left_semi").withColumn("profile", F.lit("observed"))
    rows = model.select(*columns).join(scalars.select(key, raw, corrected, F.col("correction_source").alias("_source")), key)
    scaled = F.when((raw > 0) & (F.col("_source") != RAW_SOURCE), corrected_temperature(t, raw, corrected)).otherwise(F.col(t))
    both = F.explode(F.array(F.struct(F.lit("model").alias("profile"), F.col(t).alias("_t")), F.struct(F.lit("corrected").alias("profile"), scaled.alias("_t"))))
    rows = rows.withColumn("_p", both).select(key, z, F.col("_p._t").alias(t), *keep, "_p.profile")
    return seen.select(*rows.columns).unionByName(rows)


def pick_cast(pairs: DataFrame, date_col: str, date, lat: float, lon: float, tie: str = "cast_id") -> DataFrame:
    """The cast of a date closest in planar degrees."""
    return pairs.where(F.col(date_col) == date).withColumn(
        "deg2", planar_deg2(F.lit(lon), F.lit(lat), "lon", "lat")).orderBy("deg2", tie).limit(1)


def pick_largest_delta(pairs: DataFrame, delta: str, tie: str = "cast_id") -> DataFrame:
    """The cast with the largest positive delta."""
    return pairs.where(F.col(delta) > 0).orderBy(F.desc(delta), tie).limit(1)


def within_track(casts: DataFrame, track: DataFrame, pad_deg: float = 5.0, date="dt", time="iso_time") -> DataFrame:
    """Casts inside the padded box of a track, on one of its dates."""
    dates = track.select(F.to_date(time).alias(date)).distinct()
    box = track.agg(F.struct(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"),
                             F.max("lon").alias("e")).alias("b"))
    rows = restrict_to_dates(casts, dates, date).withColumn("_b", box.scalar())
    inside = in_bbox(F.col("_b.w") - pad_deg, F.col("_b.s") - pad_deg, F.col("_b.e") + pad_deg, F.col("_b.n") + pad_deg)
    return rows.where(inside).drop("_b")


def pair_event(track: DataFrame, casts: DataFrame, levels: DataFrame, grid: DataFrame, *, pad_deg: float = 5.0,
               metric: str = "planar_deg", gate: dict | None = None) -> DataFrame:
    """Casts of a storm with observed and same-day modelled heat content, and the delta."""
    from .filters import gate_profiles
    from .profiles import heat_excess_trapezoid
    from .spatial import nearest_cell

    near = within_track(casts, track, pad_deg)
    own = gate_profiles(levels.join(near.select("cast_id"), "cast_id", "left_semi"), ["cast_id"], "depth_m", **(gate or {}))
    heat = heat_excess_trapezoid(own).select("cast_id", F.col("d26_m").alias("obs_d26_m"),
                                             F.col("tchp_kj_per_cm2").alias("obs_tchp_kj_cm2"))
    cells = nearest_cell(near.join(heat.select("cast_id"), "cast_id", "left_semi"), grid, obs_cols=["cast_id", "dt"], metric=metric)
    model = grid.select("dt", "y", "x", F.col("tchp").alias("model_tchp_kj_cm2"))
    out = cells.join(model.hint("merge"), ["dt", "y", "x"]).join(heat, "cast_id")
    return out.select("cast_id", "dt", "y", "x", F.col("distance_km").alias("model_grid_distance_km"), "obs_d26_m",
                      "obs_tchp_kj_cm2", "model_tchp_kj_cm2",
                      (F.col("obs_tchp_kj_cm2") - F.col("model_tchp_kj_cm2")).alias("tchp_delta_kj_cm2"))


def attach_features(pred: DataFrame, features: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left many-to-one join; exact copies of a feature row are dropped, other repeats are an error."""
    unique = features.dropDuplicates()
    if check and not unique.groupBy(*keys).count().where("count > 1").isEmpty():
        raise AlignmentError("features repeat on the keys")
    return pred.join(unique, list(keys), "left")
