"""Feature recipes (M8, M9). Names are fixed values; the recipes are built from them by rule."""

from __future__ import annotations

STATE = ["model_interp_tchp_kj_per_cm2", "model_interp_d26_m"]
CALENDAR = ["year", "month_int", "month_sin", "month_cos", "doy_sin", "doy_cos", "is_winter_jfm", "is_summer_jas", "is_other"]
PLACE = ["lat", "lon", "abs_lat"]
BASE = CALENDAR + PLACE + ["nearest_rtofs_grid_distance_km"] + STATE
LAT_INTERACTIONS = ["model_ssh_x_abs_lat", "model_mlt_x_abs_lat", "model_temp_excess_x_abs_lat"]
SURFACE = ["model_ssh_m", "model_mixed_layer_thickness_m", "model_surface_boundary_layer_thickness_m",
           "model_temp_excess_26c", "d26_minus_mlt_m", "d26_to_sblt_ratio"]
PROFILE_CORE = ["model_steric_1000_ref2000_m", "model_n2_max_upper200_s2", "model_n2_mean_to_d26_s2"]
STERIC_SURFACE = "model_steric_0_1000_m"
BARRIER = "model_blt_dt02_m"
NEIGHBOURHOOD = [
    "model_tchp_local_std_1deg", "model_tchp_local_std_2deg", "model_tchp_grad_mag_per_100km", "model_tchp_anom_from_1deg_mean",
    "model_d26_local_std_1deg", "model_d26_grad_mag_per_100km", "model_d26_anom_from_1deg_mean",
    "model_sst_local_std_1deg", "model_sst_grad_mag_per_100km", "model_sst_anom_from_1deg_mean",
]
STRATIFICATION = ["model_n2_max_near_mld_s2", "model_n2_max_above_mld_s2", "model_barrier_layer_thickness_m", "model_ild_m"]
OPTIONAL = ["model_ild_dt02_m", "model_blt_dt02_m"]


def without(columns, *drop):
    return [c for c in columns if c not in drop]


def recipes(target: str) -> dict[str, list[str]]:
    """M8: eleven named recipes for ``tchp`` or ``d26``."""
    place_free = without(BASE, *PLACE)
    pruned = BASE + SURFACE + LAT_INTERACTIONS
    full = pruned + PROFILE_CORE
    if target == "tchp":
        nbhd = pruned + NEIGHBOURHOOD
        return {
            "base": BASE,
            "global_pruned": pruned,
            "global_pruned_no_spatial": place_free + SURFACE,
            "global_pruned_plus_neighborhood": nbhd,
            "global_pruned_plus_stratification": pruned + STRATIFICATION,
            "global_pruned_plus_nbhd_plus_strat": nbhd + STRATIFICATION,
            "global_pruned_plus_nbhd_plus_steric0_1000": nbhd + [STERIC_SURFACE],
            "global_pruned_plus_nbhd_plus_blt02": nbhd + [BARRIER],
            "drop_temp_lat_interaction": without(full, "model_temp_excess_x_abs_lat"),
            "drop_ssh_lat_interaction": without(full, "model_ssh_x_abs_lat"),
            "surface_temp_swap": without([*full, "model_surface_temp_c"], "model_temp_excess_26c", "model_temp_excess_x_abs_lat"),
        }
    if target == "d26":
        both = without(full, "model_ssh_x_abs_lat", "model_temp_excess_x_abs_lat")
        return {
            "base": BASE,
            "global_pruned": pruned,
            "drop_both_lat_interactions": both,
            "drop_both_lat_interactions_no_spatial": without(both, *PLACE, *LAT_INTERACTIONS),
            "drop_both_lat_interactions_plus_neighborhood": both + NEIGHBOURHOOD,
            "drop_both_lat_interactions_plus_stratification": both + STRATIFICATION,
            "drop_both_lat_interactions_plus_nbhd_plus_strat": both + NEIGHBOURHOOD + STRATIFICATION,
            "drop_both_plus_nbhd_steric0_1000": without(both, "model_steric_1000_ref2000_m") + [STERIC_SURFACE] + NEIGHBOURHOOD,
            "drop_both_plus_nbhd_blt02": both + NEIGHBOURHOOD + [BARRIER],
            "drop_temp_lat_interaction": without(full, "model_temp_excess_x_abs_lat"),
            "global_pruned_plus_profile_core": full,
        }
    raise ValueError(f"unknown target {target!r}")


def geography_ladder(state: list[str]) -> dict[str, list[str]]:
    """M9: nested sets that add |lat|, its interactions, and finally the position."""
    with_abs = state + ["abs_lat"]
    with_physics = with_abs + LAT_INTERACTIONS
    return {"F0_state_only": state, "F1a_abslat": with_abs, "F1b_abslat_physics": with_physics,
            "F2_geo_state": with_physics + ["lat", "lon"]}
