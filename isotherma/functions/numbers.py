"""Numeric guards and feature arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import _col

REF_TEMP_C = 26.0
INTENSIFICATION_KJ_PER_CM2 = 50.0

__all__ = [
    "REF_TEMP_C", "finite", "safe_float", "round_half_even", "physics_features",
    "model_minus_climatology", "enriched_flags", "intensification_flag", "ratio",
    "corrected_temperature", "null_non_finite",
]


def finite(c) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def null_non_finite(df: DataFrame) -> DataFrame:
    """Map NaN and infinities to NULL in every floating column of a source."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def safe_float(text) -> Column:
    """Numeric reading of a text column; non-numeric, NaN and infinite become NULL."""
    return finite(_col(text).try_cast("double"))


def round_half_even(c, digits: int) -> Column:
    return F.bround(_col(c), digits)


def ratio(num, den) -> Column:
    """Quotient, NULL on a zero divisor."""
    return F.try_divide(_col(num), _col(den))


def physics_features(sst="sst_c", ssh="ssh_m", mlt="mlt_m", sblt="sblt_m", d26="d26_m", lat="lat",
                     ref: float = REF_TEMP_C) -> dict[str, Column]:
    """Derived structure features, by name."""
    sst, ssh, mlt, sblt, d26 = map(_col, (sst, ssh, mlt, sblt, d26))
    excess, abs_lat = sst - ref, F.abs(_col(lat))
    return {
        "model_temp_excess_26c": excess,
        "model_warm_surface_flag": F.when(sst.isNull(), -1).otherwise((sst >= ref).cast("int")),
        "d26_minus_mlt_m": d26 - mlt,
        "d26_minus_sblt_m": d26 - sblt,
        "d26_to_mlt_ratio": ratio(d26, mlt),
        "d26_to_sblt_ratio": ratio(d26, sblt),
        "warm_layer_thickness_positive_m": F.when(
            d26.isNotNull() & mlt.isNotNull(), F.greatest(d26 - mlt, F.lit(0.0))),
        "model_ssh_x_abs_lat": ssh * abs_lat,
        "model_mlt_x_abs_lat": mlt * abs_lat,
        "model_temp_excess_x_abs_lat": excess * abs_lat,
    }


def model_minus_climatology(model, clim) -> Column:
    return _col(model) - _col(clim)


def enriched_flags(tchp, d26, lat, region) -> dict[str, Column]:
    """Region one-hots, finite flags and latitude interactions, by name."""
    tchp, d26, lat, region = map(_col, (tchp, d26, lat, region))
    names = ("atlantic", "indian", "pacific", "northern_high_lat", "southern_high_lat")
    out = {f"region_{n}": (region == n).cast("int") for n in names}
    out["warm_tchp_flag"] = tchp.isNotNull().cast("int")
    out["warm_d26_flag"] = d26.isNotNull().cast("int")
    out["model_tchp_x_abs_lat"] = tchp * F.abs(lat)
    out["model_d26_x_abs_lat"] = d26 * F.abs(lat)
    return out


def intensification_flag(tchp, threshold: float = INTENSIFICATION_KJ_PER_CM2) -> Column:
    return _col(tchp) > threshold


def corrected_temperature(temp, raw_tchp, corrected_tchp, ref: float = REF_TEMP_C) -> Column:
    """Scale the warm part of a profile by corrected / raw heat content; both floored at 0."""
    temp = _col(temp)
    factor = F.greatest(F.lit(0.0), ratio(F.greatest(F.lit(0.0), _col(corrected_tchp)), raw_tchp))
    return F.when(temp >= ref, ref + (temp - ref) * factor).otherwise(temp)
