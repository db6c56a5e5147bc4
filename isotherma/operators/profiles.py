"""Profile operators (A1-A17) over long tables, one row per level.

Every profile is scanned in depth segments (see ``ordered.scan``), so one very long profile is
shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import REF_TEMP_C, corrected_temperature, finite
from .ordered import SEG, scan, until_first

# Seawater constants and layer-depth criteria.
DENSITY_KG_PER_M3 = 1026.0
CP_J_PER_KG_K = 4180.0
J_PER_M2_TO_KJ_PER_CM2 = 1.0e-7
PA_PER_M = 9806.0
GRAVITY_M_PER_S2 = 9.81
MLD_DSIGMA_KG_M3 = 0.125
ILD_DTEMP_C = 0.5
ILD_DTEMP2_C = 0.2
NEAR_MLD_M = 20.0
PA_PER_DBAR = 1.0e4

# Depth covered by one scan segment; a profile has at most max_depth / SEGMENT_M of them.
SEGMENT_M = 250.0
SEGMENT_LAYERS = 64.0


def check_vertical_axis(axis: str) -> str:
    """Only "pressure" and "depth" are known axes."""
    if axis not in ("pressure", "depth"):
        raise ValueError(f"unsupported vertical axis {axis!r}")
    return axis


def clean_profile(levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A1: keep levels whose listed values are all finite."""
    keep = None
    for c in columns:
        ok = finite(c).isNotNull()
        keep = ok if keep is None else keep & ok
    return levels.where(keep)


def _interpolate(prev: str, z: str, v: str, target: Column) -> Column:
    z0, v0 = F.col(f"{prev}.{z}"), F.col(f"{prev}.{v}")
    return z0 + (v0 - target) / (v0 - F.col(v)) * (F.col(z) - z0)


def isotherm_depth(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c",
                   ref: float = REF_TEMP_C) -> DataFrame:
    """A2: depth where the profile first cools to ``ref``; one row per profile, NULL if it does not."""
    return heat_excess_trapezoid(levels, key, z, t, ref).select(*key, "d26_m")


def heat_excess_trapezoid(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c",
                          ref: float = REF_TEMP_C, rho=DENSITY_KG_PER_M3, cp=CP_J_PER_KG_K) -> DataFrame:
    """A2, A3, A4: heat above the ``ref`` isotherm by the trapezoid rule.

    ``rho`` and ``cp`` are constants, or names of per-level columns. The node at the isotherm has no
    excess, so its own properties drop out of the integral.
    """
    per_level = isinstance(rho, str)
    value = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    used = [z, t] + ([rho, cp] if per_level else [])
    rows = clean_profile(levels, used).select(*key, *used)
    rows = rows.withColumn("_heat", F.greatest(F.col(t) - ref, F.lit(0.0)) * value(rho) * value(cp))
    rows = scan(rows, key, z, SEGMENT_M, carry=[t, "_heat"])
    z0, t0, h0 = F.col(f"_prev.{z}"), F.col(f"_prev.{t}"), F.col("_prev._heat")
    d26 = F.when(t0 == F.col(t), F.col(z)).otherwise(_interpolate("_prev", z, t, F.lit(float(ref))))
    cut = F.struct(d26.alias("d26"), (h0 / 2 * (d26 - z0)).alias("partial"), (z0 == d26).cast("int").alias("on_node"))
    out = until_first(rows, key, z, F.col("_prev").isNotNull() & (F.col(t) <= ref), cut, {
        "heat": F.coalesce((h0 + F.col("_heat")) / 2 * (F.col(z) - z0), F.lit(0.0)), "above": F.lit(1)})
    warm = (F.col(f"first_row.{t}") >= ref) & (F.col("n_rows") >= 2) & F.col("found").isNotNull()
    integral = F.when(warm, F.col("heat") + F.col("found.partial"))
    return out.select(
        *key, F.when(warm, F.col("found.d26")).alias("d26_m"), integral.alias("integral_j_per_m2"),
        (integral * J_PER_M2_TO_KJ_PER_CM2).alias("tchp_kj_per_cm2"),
        F.when(F.col("n_rows") >= 2, F.col(f"first_row.{t}")).alias("surface_temp_c"),
        F.col("last_order").alias("max_depth_m"),
        F.when(warm, F.col("above") - F.col("found.on_node")).otherwise(0).cast("long").alias("levels_above"),
        F.col("n_rows").alias("n_levels"),
        F.lit("variable_density" if per_level else "constant_density").alias("method"))


def heat_excess_layers(layers: DataFrame, key: Sequence[str] = ("cast_id",), k="k", thickness_pa="thk_pa",
                       t="temp_c", s="salinity_psu", rho=DENSITY_KG_PER_M3, cp=CP_J_PER_KG_K,
                       ref: float = REF_TEMP_C) -> DataFrame:
    """A5: heat above the isotherm from layer thicknesses, integrated from the surface.

    Invalid layers keep their place with zero thickness. An invalid layer above the crossing can pull the isotherm
    up by several layers, so the depth is joined back to the layers before they are cut at it.
    """
    value = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    valid = F.col(t).isNotNull() & F.col(s).isNotNull() & F.col(thickness_pa).isNotNull() & (F.col(thickness_pa) > 0)
    rows = layers.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("_thk", F.when(F.col("_valid"), F.col(thickness_pa) / PA_PER_M).otherwise(0.0))
    heat = F.greatest(F.col(t) - ref, F.lit(0.0)) * value(rho) * value(cp)
    rows = rows.withColumn("_heat", F.when(F.col("_valid"), heat).otherwise(0.0))
    rows = rows.select(*key, k, F.col(t).alias("_t"), "_valid", "_thk", "_heat")
    rows = scan(rows, key, k, SEGMENT_LAYERS, carry=["_t", "_thk", "_valid"], sums={"_bottom": F.col("_thk")})
    top = F.col("_bottom") - F.col("_thk")
    z0, z1 = top - F.col("_prev._thk") / 2, top + F.col("_thk") / 2
    t0, t1 = F.col("_prev._t"), F.col("_t")
    d26 = F.when((t0 != t1), z0 + F.try_divide(t0 - ref, t0 - t1) * (z1 - z0))
    scalars = rows.groupBy(*key).agg(
        F.min_by(F.struct(d26.alias("d26")), F.when(F.col("_valid") & (t1 <= ref), F.col(k))).alias("cut"),
        F.min("_head").alias("head"))
    warm = F.col("head._valid") & (F.col("head._t") >= ref)
    scalars = scalars.select(*key, F.when(warm, F.col("cut.d26")).alias("d26_m"),
                             F.when(F.col("head._valid"), F.col("head._t")).alias("surface_temp_c"))
    cut = rows.select(*key, "_bottom", top.alias("_top"), "_heat").join(scalars, list(key))
    part = F.greatest(F.least("_bottom", "d26_m") - F.col("_top"), F.lit(0.0))
    out = cut.groupBy(*key).agg(F.max("d26_m").alias("d26_m"), F.max("surface_temp_c").alias("surface_temp_c"),
                                F.sum(F.when(F.col("d26_m").isNotNull(), F.col("_heat") * part)).alias("ohc_j_per_m2"))
    return out.select(*key, "d26_m", "ohc_j_per_m2", (F.col("ohc_j_per_m2") * J_PER_M2_TO_KJ_PER_CM2).alias("tchp_kj_per_cm2"),
                      "surface_temp_c")


def heat_excess_zlevels(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c",
                        s="salinity_psu", rho=DENSITY_KG_PER_M3, cp=CP_J_PER_KG_K, ref: float = REF_TEMP_C,
                        max_depth: float | None = 1000.0) -> DataFrame:
    """Heat above the isotherm on fixed z-levels; layer edges are midpoints, the top edge is 0."""
    value = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    rows = levels if max_depth is None else levels.where(F.col(z) <= max_depth)
    valid = F.col(t).isNotNull() & F.col(s).isNotNull()
    heat = F.when(valid, F.greatest(F.col(t) - ref, F.lit(0.0)) * value(rho) * value(cp)).otherwise(0.0)
    rows = rows.select(*key, z, F.col(t).alias("_t"), valid.alias("_valid"), heat.alias("_heat"))
    rows = scan(rows, key, z, SEGMENT_M, carry=["_t", "_heat", "_valid"])
    z0, t0, h0 = F.col(f"_prev.{z}"), F.col("_prev._t"), F.col("_prev._heat")
    half = (F.col(z) - z0) / 2
    d26 = F.when(t0 != F.col("_t"), z0 + F.try_divide(t0 - ref, t0 - F.col("_t")) * (F.col(z) - z0))
    cut = F.struct(d26.alias("d26"), (h0 * F.least(d26 - z0, half)).alias("partial"))
    whole = F.when(F.col("_prev").isNull(), F.col("_heat") * F.col(z)).otherwise(half * (h0 + F.col("_heat")))
    out = until_first(rows, key, z, F.col("_valid") & (F.col("_t") <= ref), cut, {"heat": whole})
    warm = F.col("first_row._valid") & (F.col("first_row._t") >= ref)
    d26 = F.when(warm, F.col("found.d26"))
    ohc = F.when(d26.isNotNull(), F.col("heat") + F.col("found.partial"))
    return out.select(*key, d26.alias("d26_m"), ohc.alias("ohc_j_per_m2"),
                      (ohc * J_PER_M2_TO_KJ_PER_CM2).alias("tchp_kj_per_cm2"),
                      F.when(F.col("first_row._valid"), F.col("first_row._t")).alias("surface_temp_c"))


def _crossing(z: str, v: str, threshold: Column, increasing: bool) -> tuple[Column, Column]:
    """Whether a scanned row is past the threshold, and the interpolated depth there."""
    past = F.col(v) >= threshold if increasing else F.col(v) <= threshold
    z0, v0 = F.col(f"_prev.{z}"), F.col(f"_prev.{v}")
    slope = F.try_divide(threshold - v0, F.col(v) - v0)
    depth = F.when(F.col("_prev").isNull() | v0.isNull() | (v0 == F.col(v)), F.col(z))
    return past, depth.otherwise(z0 + slope * (F.col(z) - z0))


def first_crossing_depth(levels: DataFrame, threshold, increasing: bool, key: Sequence[str] = ("cast_id",),
                         z="depth_m", v="temp_c", out="crossing_m") -> DataFrame:
    """First depth past ``threshold`` (a number or Column), interpolated; the first level answers its own depth."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = scan(clean_profile(levels, [z, v]).select(*key, z, v), key, z, SEGMENT_M, carry=[v])
    past, depth = _crossing(z, v, threshold, increasing)
    return rows.groupBy(*key).agg(F.min_by(depth, F.when(past, F.col(z))).alias(out))


def layer_depths(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c",
                 sigma="sigma0") -> DataFrame:
    """Mixed-layer, isothermal-layer and barrier-layer depths from surface-relative thresholds."""
    rows = scan(clean_profile(levels, [z, t, sigma]).select(*key, z, t, sigma), key, z, SEGMENT_M, carry=[t, sigma])
    tests = {
        "mld_sigma_m": (sigma, F.col(f"_head.{sigma}") + MLD_DSIGMA_KG_M3, True),
        "ild_m": (t, F.col(f"_head.{t}") - ILD_DTEMP_C, False),
        "ild_dt02_m": (t, F.col(f"_head.{t}") - ILD_DTEMP2_C, False),
    }
    aggs = []
    for name, (v, threshold, increasing) in tests.items():
        past, depth = _crossing(z, v, threshold, increasing)
        aggs.append(F.min_by(depth, F.when(past, F.col(z))).alias(name))
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *aggs).where(F.col("_n") >= 5).drop("_n")
    thickness = lambda ild: F.when(F.col(ild).isNotNull() & F.col("mld_sigma_m").isNotNull(),
                                   F.greatest(F.col(ild) - F.col("mld_sigma_m"), F.lit(0.0)))
    return out.select("*", thickness("ild_m").alias("barrier_layer_thickness_m"),
                      thickness("ild_dt02_m").alias("blt_dt02_m"))


def stratification_summary(n2_levels: DataFrame, depths: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m",
                           n2="n2", d26="d26_m", mld="mld_sigma_m") -> DataFrame:
    """N² summaries relative to 200 m, the isotherm and the mixed layer (one row per profile)."""
    rows = clean_profile(n2_levels, [z, n2]).join(depths.select(*key, d26, mld), list(key), "left")
    upper, to_d26 = F.col(z) <= 200.0, F.col(z) <= F.col(d26)
    near = F.abs(F.col(z) - F.col(mld)) <= NEAR_MLD_M
    above = F.col(z) <= F.col(mld) - NEAR_MLD_M
    return rows.groupBy(*key).agg(
        F.avg(F.when(upper, F.col(n2))).alias("n2_mean_upper200"), F.max(F.when(upper, F.col(n2))).alias("n2_max_upper200"),
        F.avg(F.when(to_d26, F.col(n2))).alias("n2_mean_to_d26"), F.max(F.when(to_d26, F.col(n2))).alias("n2_max_to_d26"),
        F.max(F.when(near, F.col(n2))).alias("n2_max_near_mld"), F.max(F.when(above, F.col(n2))).alias("n2_max_above_mld"))


def property_at_depth(levels: DataFrame, targets: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m",
                      v="salinity_psu", target="z_star", out="value_at_depth") -> DataFrame:
    """A10: linear interpolation at one depth per profile, clamped at both ends."""
    rows = clean_profile(levels, [z, v]).select(*key, z, v).join(targets.select(*key, target), list(key))
    point = F.struct(z, v)
    sides = rows.groupBy(*key, target).agg(
        F.max(F.when(F.col(z) <= F.col(target), point)).alias("lo"), F.min(F.when(F.col(z) >= F.col(target), point)).alias("hi"))
    lo, hi = F.col(f"lo.{v}"), F.col(f"hi.{v}")
    share = F.try_divide(F.col(target) - F.col(f"lo.{z}"), F.col(f"hi.{z}") - F.col(f"lo.{z}"))
    value = F.coalesce(lo + (hi - lo) * share, lo, hi)
    return sides.select(*key, target, value.alias(out))


def integral_to_reference(levels: DataFrame, p_refs: Sequence[float], key: Sequence[str] = ("cast_id",),
                          p="depth_m", sva="sva", min_levels: int = 5) -> DataFrame:
    """Steric height from the first level to each reference pressure, and the differences.

    Trapezoid of a given specific-volume anomaly; NULL if the profile ends above the reference.
    """
    rows = scan(clean_profile(levels, [p, sva]).select(*key, p, sva), key, p, SEGMENT_M, carry=[sva])
    p0, s0 = F.col(f"_prev.{p}"), F.col(f"_prev.{sva}")
    names = [f"steric_0_{int(r)}_m" for r in p_refs]
    parts = []
    for ref, name in zip(p_refs, names):
        end = F.least(F.col(p), F.lit(float(ref)))
        s_end = s0 + (F.col(sva) - s0) * F.try_divide(end - p0, F.col(p) - p0)
        parts.append(F.sum(F.when(p0 < ref, (s0 + s_end) / 2 * (end - p0))).alias(name))
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(p).alias("_max"), *parts)
    whole = [F.when((F.col("_n") >= min_levels) & (F.col("_max") >= r), F.col(n) * PA_PER_DBAR / GRAVITY_M_PER_S2)
             .alias(n) for r, n in zip(p_refs, names)]
    out = out.select(*key, *whole)
    for (r0, n0), (r1, n1) in zip(zip(p_refs, names), list(zip(p_refs, names))[1:]):
        out = out.withColumn(f"steric_{int(r0)}_ref{int(r1)}_m", F.col(n1) - F.col(n0))
    return out


def dedupe_levels(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", carry: Sequence[str] = ("temp_c",),
                  eps: float = 1e-9, min_levels: int = 5) -> DataFrame:
    """Drop levels less than ``eps`` below the previous one; keep profiles with enough levels left."""
    rows = scan(clean_profile(levels, [z]).select(*key, z, *carry), key, z, SEGMENT_M, carry=list(carry))
    kept = rows.where(F.col("_prev").isNull() | (F.col(z) - F.col(f"_prev.{z}") > eps)).select(*key, z, *carry)
    enough = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_levels)
    return kept.join(enough.select(*key), list(key), "left_semi")


def inversion_bands(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c", sigma="sigma0",
                    min_dt: float = 0.05) -> DataFrame:
    """Runs of levels that warm with depth, with their density change; ``unstable`` if it is negative."""
    rows = scan(clean_profile(levels, [z, t, sigma]).select(*key, z, t, sigma), key, z, SEGMENT_M, carry=[t, sigma])
    rows = rows.withColumn("_warming", F.coalesce(F.col(t) - F.col(f"_prev.{t}") > 0, F.lit(False)))
    rows = rows.withColumnRenamed("_prev", "_above").drop(SEG, "_head")
    rows = scan(rows, key, z, SEGMENT_M, sums={"_island": F.when(F.col("_warming"), 0).otherwise(1)})
    bands = rows.where("_warming").groupBy(*key, "_island").agg(
        F.min("_above").alias("top"), F.max(F.struct(z, t, sigma)).alias("bottom"))
    out = bands.select(*key, F.col(f"top.{z}").alias("z_top"), F.col(f"bottom.{z}").alias("z_bottom"),
                       (F.col(f"bottom.{t}") - F.col(f"top.{t}")).alias("dt"),
                       (F.col(f"bottom.{sigma}") - F.col(f"top.{sigma}")).alias("dsigma"))
    return out.where(F.col("dt") >= min_dt).withColumn("unstable", (F.col("dsigma") < 0).cast("int"))


def rescale_profile(levels: DataFrame, scalars: DataFrame, key: Sequence[str] = ("cast_id",), t="temp_c",
                    raw="raw_tchp", corrected="corrected_tchp") -> DataFrame:
    """Corrected temperature per level from raw and corrected heat content per profile."""
    rows = levels.join(scalars.select(*key, raw, corrected), list(key))
    return rows.withColumn("corrected_temp_c", corrected_temperature(t, raw, corrected))


def profile_summary(levels: DataFrame, key: Sequence[str] = ("cast_id",), z="depth_m", t="temp_c",
                    s="salinity_psu") -> DataFrame:
    """Level count, depth range and the shallowest values."""
    return levels.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_levels"), F.max(z).alias("max_depth_m"), F.min(z).alias("min_depth_m"),
        F.min_by(t, z).alias("surface_t_c"), F.min_by(s, z).alias("surface_s_psu"))


def idw_profile(neighbours: DataFrame, columns: DataFrame, obs_key: Sequence[str], cell_key: Sequence[str],
                values: Sequence[str], level="k", distance="distance_km") -> DataFrame:
    """Inverse-distance profile of the neighbouring model columns, level by level."""
    from .spatial import idw_aggregate

    rows = neighbours.join(columns.hint("merge"), list(cell_key))
    return rows.groupBy(*obs_key, level).agg(*[idw_aggregate(v, distance).alias(v) for v in values])


