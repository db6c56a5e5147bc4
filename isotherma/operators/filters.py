"""Row selection (P1-P11), sorts and limits (O1-O5), set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import SEASON_MONTHS
from ..functions.geo import _col
from ..functions.numbers import finite
from .ordered import row_positions

GOOD_QC = ("1", "2")
PRESSURE_RANGE = (-2.0, 12000.0)
STERIC_RANGE_M = (0.3, 3.2)


def qc_levels(levels: DataFrame, values: Sequence[str], flags: Sequence[str], good: Sequence[str] = GOOD_QC) -> DataFrame:
    """Finite values and good flags."""
    for v in values:
        levels = levels.where(finite(v).isNotNull())
    for q in flags:
        levels = levels.where(F.col(q).isin(*good))
    return levels


def prefer_adjusted(levels: DataFrame, file_key: Sequence[str], values: Sequence[str], pressure: str) -> DataFrame:
    """Per file, adjusted values where any is finite, else raw.

    Columns ``<v>`` and ``<v>_adjusted`` become ``<v>``. Adjusted pressure must also be plausible. The
    choice per file is one aggregated row, joined back, so a huge file is not windowed in one task.
    """
    low, high = PRESSURE_RANGE
    aggs = []
    for v in values:
        adj = finite(f"{v}_adjusted")
        use = F.max(adj.isNotNull().cast("int")) == 1
        if v == pressure:
            use = use & (F.min(adj) >= low) & (F.max(adj) <= high)
        aggs.append(F.coalesce(use, F.lit(False)).alias(f"_use_{v}"))
    choice = levels.groupBy(*file_key).agg(*aggs)
    rows = levels.join(choice, list(file_key))
    for v in values:
        rows = rows.withColumn(v, F.when(F.col(f"_use_{v}"), finite(f"{v}_adjusted")).otherwise(finite(v)))
    return rows.drop(*[f"_use_{v}" for v in values], *[f"{v}_adjusted" for v in values])


def clip_surface_pressure(levels: DataFrame, key: Sequence[str], p: str) -> DataFrame:
    """Pressures in (-2, 0) become 0; a cast with any other negative pressure is rejected."""
    value = F.when((F.col(p) > PRESSURE_RANGE[0]) & (F.col(p) < 0), 0.0).otherwise(F.col(p))
    levels = levels.withColumn(p, value)
    bad = levels.where(F.col(p) < 0).select(*key).distinct()
    return levels.join(bad, list(key), "left_anti")


def gate_profiles(levels: DataFrame, key: Sequence[str], z: str, min_levels: int = 5, min_depth: float = 200.0) -> DataFrame:
    """Keep casts with enough levels that reach deep enough."""
    good = levels.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(z).alias("deepest"))
    good = good.where((F.col("n") >= min_levels) & (F.col("deepest") >= min_depth)).select(*key)
    return levels.join(good, list(key), "left_semi")


def in_bbox(west: float, south: float, east: float, north: float, lat="lat", lon="lon") -> Column:
    """P5: inclusive on all edges."""
    return _col(lat).between(south, north) & _col(lon).between(west, east)


def date_window(day, first: str, last: str) -> Column:
    """Inclusive; ``yyyymmdd`` strings compare as text."""
    return _col(day).between(first, last)


def season_months(alias: str) -> tuple[int, ...]:
    """Months of a season alias; an unknown alias is an error."""
    short = {"JFM": "winter_jfm", "JAS": "summer_jas"}
    name = short.get(alias.upper(), alias)
    if name not in SEASON_MONTHS:
        raise ValueError(f"unknown season {alias!r}")
    return SEASON_MONTHS[name]


def month_filter(month, alias: str) -> Column:
    return _col(month).isin(*season_months(alias))


def complete_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a finite value in every listed column."""
    for c in cols:
        df = df.where(finite(c).isNotNull())
    return df


common_support = complete_pairs


def valid_range(value, low: float | None = None, high: float | None = None) -> Column:
    """Finite and inside the closed range."""
    v = finite(value)
    ok = v.isNotNull()
    if low is not None:
        ok = ok & (v >= low)
    return ok if high is None else ok & (v <= high)


def stride_thin(grid: DataFrame, stride: int, surface: str, box: Column | None = None, limit: int | None = None,
                date: str = "dt") -> DataFrame:
    """Every ``stride``-th cell with a finite surface, of each date the first ``limit`` in row-major order."""
    rows = grid.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0) & F.col(surface).isNotNull())
    if box is not None:
        rows = rows.where(box)
    return rows if limit is None else top_per_group(rows, [date], limit, F.col("y"), F.col("x")).drop("rank")


def require_columns(df: DataFrame, recipe: Sequence[str], optional: Sequence[str] = ()) -> list[str] | None:
    """P10: the recipe, None if only optional columns are missing; other gaps are an error."""
    missing = [c for c in recipe if c not in df.columns]
    if not missing:
        return list(recipe)
    hard = [c for c in missing if c not in optional]
    if hard:
        raise ValueError(f"missing columns {hard}")
    return None


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """O2: sorted head."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def capped_per_platform(index: DataFrame, platform: str, order: str, per_platform: int, total: int) -> DataFrame:
    """O3: at most ``per_platform`` rows each in file order, then at most ``total``."""
    return top_per_group(index, [platform], per_platform, F.col(order)).orderBy(order).limit(total)


def even_sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` evenly spaced rows by a unique numeric order column (all rows if there are fewer)."""
    rows = df.count()
    if rows <= n:
        return df
    placed = row_positions(df, order, "_pos")
    # Row p is kept when floor(i * (rows - 1) / (n - 1)) = p for the smallest i that reaches it.
    i = f"((_pos * {n - 1}L + {rows - 2}L) div {rows - 1}L)"
    return placed.where(F.expr(f"_pos = ({i} * {rows - 1}L) div {n - 1}L")).drop("_pos")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A fixed random sample: the ``n`` rows whose seeded draw is smallest. ``key`` is an integer."""
    from .metrics import fixed_draw

    draw = fixed_draw(f"{seed}L", f"pmod({key}, 2147483647L)", "4294967296L")
    return df.withColumn("_draw", F.expr(draw)).orderBy("_draw", key).limit(n).drop("_draw")


def union_tables(*frames: DataFrame) -> DataFrame:
    """Union by name; absent columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys present on both sides."""
    return left.select(key).intersect(right.select(key))


def only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys missing on the right."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def season_union(aliases: Sequence[str]) -> list[int]:
    """U4: sorted distinct months of several seasons."""
    return sorted({m for a in aliases for m in season_months(a)})
