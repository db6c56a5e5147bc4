"""Labels: regions, tiles, boxes, confidence, names, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import _col, wrap_lon

# The eight named boxes (key, name, basin, south edge, west edge), 20 degrees each.
NAMED_BOXES = [
    ("gulf_of_mexico", "Gulf of Mexico & NW Caribbean", "Atlantic", 20, -100),
    ("atlantic_mdr", "Atlantic hurricane MDR / E Caribbean", "Atlantic", 0, -60),
    ("arabian_sea", "Arabian Sea", "Indian", 0, 60),
    ("bay_of_bengal", "Bay of Bengal", "Indian", 0, 80),
    ("philippine_sea", "Philippine Sea / W Pacific warm pool", "West Pacific", 0, 120),
    ("coral_sea", "Coral Sea", "South Pacific", -20, 140),
    ("central_eq_pacific", "Central equatorial N Pacific", "Central Pacific", 0, -180),
    ("sw_pacific_fiji", "SW Pacific (Fiji sector)", "South Pacific", -20, -180),
]
# The Gulf box (south, north, west, east) and the distance bin edges in km.
GULF = (18.0, 31.0, -98.0, -80.0)
SUPPORT_EDGES_KM = (50, 100, 250, 500)

__all__ = [
    "NAMED_BOXES", "GULF", "region_5", "macro_region", "expert_region", "in_gulf", "tile15", "tile20", "patch20",
    "patch_south", "patch_west", "named_boxes", "confidence", "threshold_cell", "support_bin", "platform_from_path",
    "date8_from_iso", "event_name", "slug", "obs_key", "short_name", "units_of",
]


def _basin(lon: Column) -> Column:
    return (F.when((lon >= -100) & (lon < 20), "atlantic")
            .when((lon >= 20) & (lon < 147), "indian").otherwise("pacific"))


def region_5(lat, lon) -> Column:
    lat, lon = _col(lat), _col(lon)
    return (F.when(lat.isNull() | lon.isNull(), "unknown")
            .when(lat < -40, "southern_high_lat").when(lat > 45, "northern_high_lat").otherwise(_basin(lon)))


def macro_region(lat, lon) -> Column:
    return F.when(F.abs(_col(lat)) > 45, "high_latitude").otherwise(_basin(_col(lon)))


def in_gulf(lat, lon) -> Column:
    south, north, west, east = GULF
    return _col(lat).between(south, north) & _col(lon).between(west, east)


def expert_region(lat, lon) -> Column:
    lat, lon = _col(lat), _col(lon)
    return (F.when(in_gulf(lat, lon), "gulf_of_mexico").when((lon >= -100) & (lon < 20), "atlantic")
            .when((lon >= 20) & (lon < 100), "indian").when((lon >= 100) & (lon < 160), "west_pacific")
            .otherwise("epac_other"))


def _tile(row: Column, column: Column) -> Column:
    return F.format_string("tile_%02d_%02d", row.cast("int"), column.cast("int"))


def tile15(lat, lon, deg: float = 15.0) -> Column:
    """Held-out tiles, longitude not wrapped."""
    return _tile(F.floor((_col(lat) + 90.0) / deg), F.floor((_col(lon) + 180.0) / deg))


def tile20(lat, lon, deg: float = 20.0, offset: float = 0.0) -> Column:
    """Held-out tiles shifted by ``offset`` degrees, longitude wrapped."""
    return _tile(F.floor((_col(lat) + 90.0 + offset) / deg),
                 F.floor(F.pmod(_col(lon) + 180.0 + offset, F.lit(360.0)) / deg))


def patch_south(lat, deg: float = 20.0) -> Column:
    clamped = F.greatest(F.lit(-89.999999), F.least(F.lit(89.999999), _col(lat)))
    return (F.floor(clamped / deg) * deg).cast("int")


def patch_west(lon, deg: float = 20.0) -> Column:
    return (F.floor(wrap_lon(lon) / deg) * deg).cast("int")


def patch20(lat, lon, deg: int = 20) -> Column:
    south, west = patch_south(lat, deg), patch_west(lon, deg)
    return F.format_string("lat[%d,%d) lon[%d,%d)", south, south + deg, west, west + deg)


def named_boxes(spark: SparkSession) -> DataFrame:
    """Eight literal rows: a dimension whose size is fixed."""
    return spark.createDataFrame(NAMED_BOXES, "box_key string, box_name string, basin string, lat0 int, lon0 int")


def confidence(n_nearby, has_model=None) -> Column:
    n = _col(n_nearby)
    out = F.when(n >= 3, "High").when(n >= 1, "Medium").otherwise("Low")
    return out if has_model is None else F.when(_col(has_model), out).otherwise("Low")


def threshold_cell(obs, model) -> Column:
    obs, model = _col(obs).isNotNull(), _col(model).isNotNull()
    return (F.when(obs & model, "both_cross").when(obs, "argo_only").when(model, "rtofs_only")
            .otherwise("neither_cross"))


def support_bin(km) -> Column:
    km, low, out = _col(km), 0, None
    for high in SUPPORT_EDGES_KM:
        label = f"{low}-{high}"
        out = F.when(km < high, label) if out is None else out.when(km < high, label)
        low = high
    return out.when(km >= low, f">{low}")


def platform_from_path(path) -> Column:
    return F.split_part(_col(path), F.lit("/"), F.lit(2))


def date8_from_iso(text) -> Column:
    return F.regexp_replace(F.substring(_col(text), 1, 10), "-", "")


def event_name(name, season) -> Column:
    return F.concat_ws("_", F.upper(_col(name)), _col(season).cast("string"))


def slug(text) -> Column:
    return F.lower(_col(text))


def obs_key(source_file, profile_index) -> Column:
    """Key of one profile: file and index in the file."""
    return F.concat(_col(source_file), F.lit("#prof"), _col(profile_index).cast("string"))


def short_name(name) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(name), "^model_(interp_)?", ""), "_(kj_per_cm2|m|km|c|s2)$", "")


def units_of(name) -> Column:
    """Unit of a column, read from its name."""
    n = _col(name)
    return (F.when(n.endswith("_kj_per_cm2"), "kJ/cm²").when(n.endswith("_s2"), "s⁻²").when(n.endswith("_km"), "km")
            .when(n.endswith("_m"), "m").when((n.contains("temp") & n.endswith("_c")) | n.endswith("_26c"), "°C")
            .when(n.rlike("ratio|sin|cos|flag") | n.startswith("is_"), "–")
            .when(n.isin("lat", "lon", "abs_lat"), "°").when(n.contains("grad_mag"), "per 100 km").otherwise("–"))
