"""Spatial joins (J1-J5, J17, J18) as bucketed equi-joins.

Points live on the unit sphere (or on the plane of degrees) and are cut into cubes whose side
shrinks by ``BRANCH`` per level. Working with cubes in space removes every special case at the
poles and the dateline.

``knn_join``: a query starts at the finest cube that surely holds k points; what that cube holds
bounds its reach, and it joins the points of the cubes within. A query that touches a crowded cube
opens only those with more than ``leaf`` points, coarse to fine, and keeps the cubes that can still
hold one of its k nearest. The set of open cubes is checkpointed after each round, so rounds are
run only while a crowded cube is left.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_KM, _col, haversine_km, planar_deg2, unit_xyz
from ..session import cut_lineage, stored
from . import blocks

BRANCH = 2
TIME_BITS = 3  # a time cell is split in eight per time level
TIME_LEVELS = 2
MAX_LEVELS = 20
PLAIN = 4  # times ``leaf``: cubes of up to so many points are searched whole at the first level
DISTANCE_DIGITS = 6  # km; distances are compared after rounding to a millimetre
SLACK = 1e-9
EXACT_HIT_KM = 1e-6


def _coords(metric: str) -> tuple[list[str], list[Column]]:
    """Non-negative coordinates in which one unit is the side of the coarsest cube."""
    if metric == "great_circle":
        x, y, z = unit_xyz("lat", "lon")
        return ["u0", "u1", "u2"], [x + 1.0, y + 1.0, z + 1.0]
    if metric == "planar_deg":
        return ["u0", "u1"], [(F.col("lat") + 90.0) / 180.0, (F.col("lon") + 180.0) / 180.0]
    raise ValueError(f"unknown metric {metric!r}")


def _chord(km: float) -> float:
    return 2.0 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def _box_gap(q: str, lo: str, hi: str) -> Column:
    return F.greatest(F.col(lo) - F.col(q), F.lit(0.0), F.col(q) - F.col(hi))


def _box_reach(q: str, lo: str, hi: str) -> Column:
    return F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(q) - F.col(hi)))


def _norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _explode_levels(df: DataFrame, cells: Sequence[str], levels: int, time_levels: int,
                    only: Sequence[int] | None = None) -> DataFrame:
    """One row per level a cell or point belongs to, with its cube ids ``c*`` (and time cell ``ct``)."""
    wanted = list(range(levels + time_levels + 1)) if only is None else list(only)
    df = df.withColumn("level", F.explode(F.array(*[F.lit(w) for w in wanted])))
    ids = [F.expr(f"shiftright({f}, greatest({levels} - level, 0))").alias(f"c{i}") for i, f in enumerate(cells)]
    ct = F.expr(f"shiftright(ft, {TIME_BITS} * least({levels + time_levels} - level, {time_levels}))").alias("ct")
    return df.select("*", *ids, ct)


def _level_count(points: DataFrame, equi: Sequence[str | Column]) -> int:
    """Enough levels for about one point in a cube of evenly spread data (of the largest ``equi`` group)."""
    largest = points.groupBy(*equi).count().agg(F.max("count")).first()[0] or 1
    return min(MAX_LEVELS, max(3, math.ceil(math.log(largest, 4)) + 1))


def knn_join(queries: DataFrame, points: DataFrame, k: int, *, query_cols: Sequence[str], point_cols: Sequence[str],
             equi: Sequence[str] = (), metric: str = "great_circle", radius_km: float | None = None,
             time: str | None = None, window_h: float | None = None, coincident: bool = True,
             tie: Sequence[str] = (), levels: int | None = None, leaf: int = 512) -> DataFrame:
    """The ``k`` nearest points of each query.

    Both sides have ``lat`` and ``lon`` (and the ``equi`` columns; and ``time``, in seconds as a double, when a
    window is set). ``tie`` lists point columns that order equal distances; with a time window the time gap comes
    first. Set ``coincident=False`` when points are distinct positions by construction. Result: ``query_cols``,
    ``point_cols`` (renamed ``p_lat``/``p_lon`` for the position), ``distance_km``, ``rank``
    (and ``gap_h``).
    """
    equi, tie = list(equi), list(tie) or list(point_cols)
    unames, uexprs = _coords(metric)
    dims = len(unames)
    timed = time is not None
    time_levels = TIME_LEVELS if timed else 0
    window_s = (window_h or 0.0) * 3600.0
    slab = [F.floor(F.col(time) / window_s).alias("_slab")] if timed and window_s else []  # only points of one time cell are searched together
    levels = _level_count(points, [*equi, *slab]) if levels is None else levels
    fine = [f"f{i}" for i in range(dims)]
    cube = ["level", *[f"c{i}" for i in range(dims)], "ct"]
    top_id = 2 * BRANCH ** levels

    def place(df: DataFrame) -> DataFrame:
        df = df.select("*", *[e.alias(n) for n, e in zip(unames, uexprs)])
        fs = [F.least(F.floor(F.col(u) * BRANCH ** levels), F.lit(top_id)).cast("long").alias(f)
              for u, f in zip(unames, fine)]
        ft = F.floor(F.col("t") * (2 ** (TIME_BITS * time_levels)) / window_s) if timed else F.lit(0)
        return df.select("*", *fs, ft.cast("long").alias("ft"))

    t_of = lambda name: ([F.col(name).cast("double").alias("t")] if timed else [F.lit(0.0).alias("t")])
    where_cols = [*equi, "lat", "lon", "t"]
    q_all = queries.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        *[c for c in dict.fromkeys([*query_cols, *equi, "lat", "lon"])], *t_of(time))
    p_all = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        *[c for c in dict.fromkeys([*point_cols, *equi, *tie, "lat", "lon"])], *t_of(time))
    if coincident:
        # Points at one place and time are alike for every query: k of them are enough.
        same = Window.partitionBy(*where_cols).orderBy(*tie)
        p_all = p_all.withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= k).drop("_same")
    q = place(q_all.select(*where_cols).distinct())
    p = place(p_all)

    # Cube pyramid: count and tight bounds per cube and level. Levels at which evenly spread points mostly stand alone are only made of
    # cubes that are crowded all the same. Points are summed per cube of the lower level first, then cubes.
    last = levels + time_levels
    # A cube that is to hold k points is no finer than the level at which evenly spread points come k by k.
    even = max(0, levels - dims - 1 - math.ceil(math.log(k, 4)))
    bounds = [*unames, "t"]
    lows, highs = [f"lo_{b}" for b in bounds], [f"hi_{b}" for b in bounds]

    def pyramid(rows: DataFrame, wanted: Sequence[int]) -> DataFrame:
        return _explode_levels(rows, fine, levels, time_levels, wanted).groupBy(*equi, *cube).agg(
            F.sum("cnt").alias("cnt"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])

    single = p.select(*equi, *fine, "ft", F.lit(1).cast("long").alias("cnt"), *[F.col(b).alias(c) for b, c in zip(bounds, lows)],
                      *[F.col(b).alias(c) for b, c in zip(bounds, highs)])
    base = _explode_levels(single, fine, levels, time_levels, [even])
    floor = [f"shiftleft({c}, {levels - even}) AS {f}" for c, f in zip(cube[1:-1], fine)]
    floor = base.groupBy(*equi, *cube).agg(F.sum("cnt").alias("cnt"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).selectExpr(
        *equi, *floor, f"shiftleft(ct, {TIME_BITS * time_levels}) AS ft", "cnt", *lows, *highs)
    nodes = stored(pyramid(floor, range(even + 1)), "cubes")
    if even < last:
        crowds = nodes.where((F.col("level") == even) & (F.col("cnt") > leaf)).select(*equi, *cube)
        if not crowds.isEmpty():
            inside = _explode_levels(single, fine, levels, time_levels, [even]).join(crowds.hint("merge"), [*equi, *cube], "left_semi").select(*single.columns)
            nodes = nodes.unionByName(stored(pyramid(inside, range(even + 1, last + 1)), "cubes"))

    # Finest cube of the query's own position that surely holds k points.
    own_cell = [f"q{i}" for i in range(dims)]
    q = q.select(*q.columns, *[F.expr(f"shiftright({f}, {levels - even})").alias(c) for f, c in zip(fine, own_cell)],
                 F.expr(f"shiftright(ft, {TIME_BITS * time_levels})").alias("qt"))
    own = _explode_levels(q.select(*equi, *own_cell, F.col("qt").alias("ft")).distinct(), own_cell, even, 0).withColumnRenamed("ft", "qt")
    extent = [f"{side}_{b}" for b in bounds for side in ("lo", "hi")]
    start = own.join(nodes.where(F.col("cnt") >= k).hint("merge"), [*equi, *cube]).groupBy(*equi, *own_cell, "qt").agg(
        F.max("level").alias("start"), *[F.max_by(e, "level").alias(f"own_{e}") for e in extent])
    q = q.join(start.hint("merge"), [*equi, *own_cell, "qt"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    if radius_km is not None:
        # No coarser than the radius: a few cubes of its size cover the ball.
        q = q.withColumn("start", F.greatest("start", F.lit(min(even, max(0, int(-math.log2(_chord(radius_km))))))))
    # Its k points are no farther than the far corner of what that cube holds. Cubes up to twice as coarse, of every second level, are
    # searched within that reach: a query touches few of them, and points are keyed by few levels.
    reach = F.coalesce(_norm([_box_reach(u, f"own_lo_{u}", f"own_hi_{u}") for u in unames]), F.lit(10.0))
    limit = reach if radius_km is None else F.least(reach, F.lit(_chord(radius_km)))
    coarse = F.greatest(F.col("start") - 1, F.lit(0))
    q_keys = [*where_cols, *unames]
    q = stored(q.select(*q_keys, "qt", (coarse - coarse % 2).alias("level"), limit.alias("cap")), "knn-queries")

    def measured(front: DataFrame) -> DataFrame:
        gaps = [_box_gap(u, f"lo_{u}", f"hi_{u}") for u in unames]
        reach = [_box_reach(u, f"lo_{u}", f"hi_{u}") for u in unames]
        front = front.select("*", _norm(gaps).alias("near"), _norm(reach).alias("far"),
                             _box_gap("t", "lo_t", "hi_t").alias("near_t"), _box_reach("t", "lo_t", "hi_t").alias("far_t"))
        if timed:
            front = front.where(F.col("near_t") <= window_s)
        if radius_km is not None:
            front = front.where(F.col("near") <= _chord(radius_km) + SLACK)
        return front

    crowded = (F.col("cnt") > leaf) & (F.col("level") < last)
    state = [*q_keys, *cube, "cnt", "near", "far", "near_t", "far_t", "cap"]

    def pruned(front: DataFrame) -> DataFrame:
        """Drop cubes that lie behind k surely valid points."""
        by_q = Window.partitionBy(*where_cols)
        inside = F.lit(True) if not timed else F.col("far_t") <= window_s
        front = front.withColumn("_cum", F.sum(F.when(inside, F.col("cnt")).otherwise(0)).over(
            by_q.orderBy("far", "far_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        front = front.withColumn("_cap", F.min(F.when(F.col("_cum") >= k, F.struct("far", "far_t"))).over(by_q))
        cap, cap_t = F.col("_cap.far"), F.col("_cap.far_t")
        behind = (F.col("near") > cap + SLACK) | (
            (F.col("near") == cap) & (F.col("far") == F.col("near")) & (F.col("near_t") > cap_t))
        front = front.where(F.col("_cap").isNull() | ~behind).withColumn("cap", F.coalesce(cap, F.lit(10.0)))
        front = front.select(*state)
        return front.withColumn("_busy", F.max(crowded.cast("int")).over(by_q))

    def touched(q: DataFrame) -> DataFrame:
        """Cubes of a query's level that the ball of its reach touches, one axis at a time."""
        t_steps = F.array(*[F.lit(s) for s in ((-1, 0, 1) if timed else (0,))])
        front = q.select(*q_keys, "level", "cap", F.pow(F.lit(float(BRANCH)), -F.col("level")).alias("_side"), "qt")
        front = front.select("*", F.lit(0.0).alias("_gap2"), F.explode(t_steps).alias("_dt"))
        front = front.withColumn("ct", F.col("qt") + F.col("_dt"))
        for i, u in enumerate(unames):
            first = F.greatest(F.floor((F.col(u) - F.col("cap") - SLACK) / F.col("_side")), F.lit(0))
            final = F.least(F.floor((F.col(u) + F.col("cap") + SLACK) / F.col("_side")), F.floor(2.0 / F.col("_side")))
            front = front.withColumn(f"c{i}", F.explode(F.sequence(first, final)))
            low = F.col(f"c{i}") * F.col("_side")
            gap = F.greatest(low - F.col(u), F.lit(0.0), F.col(u) - low - F.col("_side"))
            front = front.withColumn("_gap2", F.col("_gap2") + gap * gap).where(F.col("_gap2") <= F.pow(F.col("cap") + SLACK, 2))
        if metric == "great_circle":
            # The sphere has radius 1 around (1, 1, 1): a cube it does not cross is empty.
            centre = [(F.col(f"c{i}") + 0.5) * F.col("_side") - 1.0 for i in range(dims)]
            front = front.where(F.abs(_norm(centre) - 1.0) <= F.col("_side") * 0.8661)
        return front.select(*q_keys, *cube, "cap")

    # Queries that touch no very crowded cube go to the points of their cubes at once; the others open cubes in rounds.
    used = {r["level"] for r in q.select("level").distinct().collect()}  # at most ``last`` + 1 numbers
    crowds = nodes.where(crowded & (F.col("cnt") > PLAIN * leaf) & F.col("level").isin(*used)).select(*equi, *cube)
    thick = [r["level"] for r in crowds.select("level").distinct().collect()] if used else []  # likewise
    leaves, front = touched(q), None
    if thick:
        near_crowd = q.where(F.col("level").isin(thick))
        busy = stored(touched(near_crowd).join(crowds.hint("merge"), [*equi, *cube], "left_semi").select(*where_cols).distinct(), "knn-busy")
        if not busy.isEmpty():
            calm = near_crowd.join(busy.hint("merge"), where_cols, "left_anti")
            leaves = touched(q.where(~F.col("level").isin(thick)).unionByName(calm))
            front = touched(near_crowd.join(busy.hint("merge"), where_cols, "left_semi")).drop("cap")
            front = cut_lineage(pruned(measured(front.join(nodes.hint("merge"), [*equi, *cube]))))

    parent = [f"p{i}" for i in range(dims)]
    finer = nodes.where("level > 0").select(
        "*", *[F.expr(f"CASE WHEN level <= {levels} THEN shiftright(c{i}, 1) ELSE c{i} END").alias(parent[i])
               for i in range(dims)],
        F.expr(f"CASE WHEN level <= {levels} THEN ct ELSE shiftright(ct, {TIME_BITS}) END").alias("pt"))
    while front is not None:
        settled = front.where("_busy = 0").select(*q_keys, *cube, "cap")
        leaves = leaves.unionByName(settled)
        used |= {r["level"] for r in settled.select("level").distinct().collect()}
        active = front.where("_busy = 1").select(*[c for c in state if c != "cap"])
        if active.isEmpty():
            break
        opened = active.where(crowded).select(
            *q_keys, (F.col("level") + 1).alias("level"), *[F.col(f"c{i}").alias(parent[i]) for i in range(dims)],
            F.col("ct").alias("pt"))
        opened = measured(opened.join(finer.hint("merge"), [*equi, "level", *parent, "pt"])).select(*active.columns)
        front = cut_lineage(pruned(active.where(~crowded).unionByName(opened)))

    # Exact distances against the points of the remaining cubes.
    payload = [c for c in dict.fromkeys([*point_cols, *tie]) if c not in equi]
    p_keyed = _explode_levels(p, fine, levels, time_levels, sorted(used) or [0]).select(
        *equi, *cube, *[F.col(u).alias(f"p_{u}") for u in unames], *[F.col(c).alias(f"pc_{c}") for c in payload], F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
        F.col("t").alias("p_t"))
    pairs = leaves.join(p_keyed.hint("merge"), [*equi, *cube])
    # The k-th point is no farther than the cap: drop what lies beyond before ranking, by straight-line distance first.
    pairs = pairs.where(_norm([F.col(u) - F.col(f"p_{u}") for u in unames]) <= F.col("cap") + SLACK)
    km = F.round(haversine_km("lon", "lat", "p_lon", "p_lat"), DISTANCE_DIGITS)
    order = km if metric == "great_circle" else F.round(planar_deg2("lon", "lat", "p_lon", "p_lat"), 9)
    gap = F.abs(F.col("p_t") - F.col("t"))
    pairs = pairs.select("*", km.alias("distance_km"), order.alias("_order"), gap.alias("_gap"))
    if timed:
        pairs = pairs.where(F.col("_gap") <= window_s)
    if radius_km is not None:
        pairs = pairs.where(F.col("distance_km") <= radius_km)
    ranking = Window.partitionBy(*where_cols).orderBy("_order", *(["_gap"] if timed else []), *[f"pc_{c}" for c in tie])
    best = pairs.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
    # Equality of doubles is exact here: both sides carry the same values.
    out = q_all.join(best.select(*where_cols, "rank", "distance_km", "_gap", "p_lat", "p_lon",
                                 *[f"pc_{c}" for c in payload]).hint("merge"), where_cols)
    keep = [F.col(c) for c in dict.fromkeys([*query_cols])]
    names = [F.col(f"pc_{c}").alias(c if c not in query_cols else f"p_{c}") for c in payload]
    extra = [(F.col("_gap") / 3600.0).alias("gap_h")] if timed else []
    return out.select(*keep, *names, "p_lat", "p_lon", "distance_km", "rank", *extra)


def nearest_cell(obs: DataFrame, grid: DataFrame, *, obs_cols: Sequence[str], date="dt", valid="sst_c",
                 metric: str = "great_circle", cell=("y", "x"), levels: int | None = None) -> DataFrame:
    """Nearest valid cell of the same date."""
    points = grid.where(F.col(valid).isNotNull())
    return knn_join(obs, points, 1, query_cols=obs_cols, point_cols=list(cell), equi=[date], metric=metric,
                    coincident=False, levels=levels).drop("rank")


def knn_cells(obs: DataFrame, geometry: DataFrame, k: int = 8, *, obs_cols: Sequence[str], cell=("y", "x"),
              levels: int | None = None) -> DataFrame:
    """K nearest cells of the static geometry, for every date at once."""
    return knn_join(obs, geometry, k, query_cols=obs_cols, point_cols=list(cell), coincident=False, levels=levels)


def idw_aggregate(value: str, distance: str = "distance_km", exact_km: float = EXACT_HIT_KM, order: str = "rank") -> Column:
    """Inverse-distance-squared mean of a group; NULL values drop out; an exact finite hit wins."""
    v, d = _col(value), _col(distance)
    weight = F.when(v.isNotNull(), 1.0 / F.pow(F.greatest(d, F.lit(exact_km)), 2))
    hit = F.min_by(v, F.when((d <= exact_km) & v.isNotNull(), d))
    return F.coalesce(hit, F.try_divide(F.sum(weight * v), F.sum(weight)))


def idw_sample(neighbours: DataFrame, grid: DataFrame, fields: Sequence[str], *, obs_cols: Sequence[str],
               cell=("y", "x"), date="dt") -> DataFrame:
    """Sample grid fields at the observations from their neighbour cells of the same date."""
    rows = neighbours.join(grid.select(date, *cell, *fields).hint("merge"), [date, *cell])
    return rows.groupBy(*obs_cols).agg(F.min("distance_km").alias("nearest_km"), *[idw_aggregate(f).alias(f) for f in fields])


def support_join(queries: DataFrame, obs: DataFrame, *, query_cols: Sequence[str], obs_cols: Sequence[str], time="ts",
                 radius_km: float = 200.0, window_h: float = 72.0, limit: int = 10, tie: Sequence[str] = (),
                 levels: int | None = None) -> DataFrame:
    """Observations within the radius and time window, nearest first, then smallest time gap."""
    kept = lambda df, cols: df.select(*dict.fromkeys([*cols, "lat", "lon"]), F.col(time).cast("double").alias("t"))
    order = list(tie) or list(obs_cols)
    near = blocks.nearest_within(kept(queries, query_cols), kept(obs, [*obs_cols, *order]), limit, radius_km, window_h * 3600.0, order)
    names = [F.col(f"_r.{c}").alias(c if c not in query_cols else f"p_{c}") for c in dict.fromkeys([*obs_cols, *order])]
    km = F.round(haversine_km("_l.lon", "_l.lat", "_r.lon", "_r.lat"), DISTANCE_DIGITS)
    return near.select(*[F.col(f"_l.{c}").alias(c) for c in dict.fromkeys(query_cols)], *names, F.col("_r.lat").alias("p_lat"), F.col("_r.lon").alias("p_lon"),
                       km.alias("distance_km"), "rank", (F.abs(F.col("_r.t") - F.col("_l.t")) / 3600.0).alias("gap_h"))


def nearest_support_km(test: DataFrame, train: DataFrame, *, test_cols: Sequence[str], train_id: str,
                       same: Sequence[str] = (), levels: int | None = None) -> DataFrame:
    """Distance from each test point to the nearest training point (of the same platform if asked)."""
    near = knn_join(test, train, 1, query_cols=test_cols, point_cols=[train_id], equi=same, tie=[train_id], levels=levels)
    return near.select(*test_cols, F.col("distance_km").alias("support_km"))


POINTS_PER_SALT = 2_000


def radius_pairs(cells: DataFrame, points: DataFrame, radius_km: float, *, cell_cols: Sequence[str],
                 point_cols: Sequence[str], any_point: bool = False) -> DataFrame:
    """Cells paired with the points within a radius, or with ``any_point`` the cells that have one; the work is linear in the points.

    Points keep one row each; cells are copied to the cubes their radius touches, as far as those hold points. A cube is dealt over as many
    salts as its points need, so a crowded one is shared by many tasks, each with its few cells.
    """
    side = max(_chord(radius_km), 1e-7)
    unames, uexprs = _coords("great_circle")
    ids = [f"c{i}" for i in range(3)]
    pts = points.select(*point_cols, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
                        *[F.floor(u / side).cast("long").alias(c) for u, c in zip(uexprs, ids)])
    cubes = pts.groupBy(*ids).agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_SALT).cast("int").alias("_salts"))
    pts = pts.join(cubes.hint("merge"), ids).withColumn("salt", F.pmod(F.xxhash64("p_lat", "p_lon"), F.col("_salts")).cast("int")).drop("_salts")
    steps = list(itertools.product((-1, 0, 1), repeat=3))
    offsets = F.array(*[F.struct(*[F.lit(s).alias(f"d{i}") for i, s in enumerate(step)]) for step in steps])
    near = cells.select(*cell_cols, "lat", "lon", *[u.alias(n) for u, n in zip(uexprs, unames)])
    near = near.select("*", F.explode(offsets).alias("_o"))
    near = near.select("*", *[(F.floor(F.col(u) / side) + F.col(f"_o.d{i}")).cast("long").alias(ids[i])
                              for i, u in enumerate(unames)])
    gaps = [F.greatest(F.col(c) * side - F.col(u), F.lit(0.0), F.col(u) - (F.col(c) + 1) * side) for c, u in zip(ids, unames)]
    centre = [(F.col(c) + 0.5) * side - 1.0 for c in ids]
    near = near.where((_norm(gaps) <= side + SLACK) & (F.abs(_norm(centre) - 1.0) <= side * 0.8661 + SLACK))
    near = near.select(*cell_cols, "lat", "lon", *ids).join(cubes.hint("merge"), ids)
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt")).drop("_salts")
    km = F.round(haversine_km("lon", "lat", "p_lon", "p_lat"), DISTANCE_DIGITS)
    if any_point:  # the join looks no further once a cell has a point
        same = [near[c] == pts[c] for c in [*ids, "salt"]]
        return near.hint("merge").join(pts.hint("merge"), [*same, km <= radius_km], "left_semi").select(*cell_cols).distinct()
    pairs = near.hint("merge").join(pts, [*ids, "salt"])
    return pairs.withColumn("distance_km", km).where(F.col("distance_km") <= radius_km).drop(*ids, "salt")


def gaussian_fields(obs: DataFrame, cells: DataFrame, values: Sequence[str], *, cell_cols: Sequence[str], by: Sequence[str] = (),
                    length_km: float = 100.0, radius_km: float = 300.0) -> DataFrame:
    """Gaussian-weighted means of several fields around each cell, apart for each group of ``by``, from one pass over the pairs.

    Observations at one position share a weight, so they are summed before the join. A row per cell and group that has an observation within the
    radius: ``<value>``, ``<value>_n`` and ``<value>_km``, the distance of the nearest; NULL, 0 and NULL for a field without any.
    """
    by = list(by)
    sums = [c for v in values for c in (F.sum(v).alias(f"_v_{v}"), F.count(v).alias(f"_n_{v}"))]
    known = F.coalesce(*[F.col(v).cast("double") for v in values]).isNotNull()
    points = obs.where(known).groupBy("lat", "lon", *by).agg(*sums).withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    per_cell = blocks.weighted_sums(cells.select(*dict.fromkeys([*cell_cols, "lat", "lon"])), points.drop(*by), values, radius_km, length_km)
    fields = [c for v in values for c in (
        F.try_divide(F.sum(f"a_{v}"), F.sum(f"b_{v}")).alias(v), F.sum(f"n_{v}").alias(f"{v}_n"), F.min(f"k_{v}").alias(f"{v}_km"))]
    out = per_cell.groupBy("_group", *[F.col(f"_l.{c}").alias(c) for c in cell_cols]).agg(*fields)
    if by:
        groups = obs.where(known).select(*by).distinct().withColumn("_group", F.xxhash64(*by))
        out = out.join(groups, "_group")
    return out.select(*cell_cols, *by, *[c for v in values for c in (v, f"{v}_n", f"{v}_km")])


def gaussian_grid(obs: DataFrame, cells: DataFrame, value: str, *, cell_cols: Sequence[str], length_km: float = 100.0,
                  radius_km: float = 300.0, mask_km: float | None = None) -> DataFrame:
    """Gaussian-weighted mean of the observations around each cell.

    NULL where no observation lies within the radius, or the nearest is beyond the mask.
    """
    out = gaussian_fields(obs, cells, [value], cell_cols=cell_cols, length_km=length_km, radius_km=radius_km).withColumnsRenamed(
        {f"{value}_n": "n_obs", f"{value}_km": "nearest_km"})
    if mask_km is not None:
        out = out.withColumn(value, F.when(F.col("nearest_km") <= mask_km, F.col(value)))
    full = cells.select(*cell_cols).join(out.hint("merge"), list(cell_cols), "left")  # a row per cell: not to pass through the driver
    return full.withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))


def distance_mask(cells: DataFrame, obs: DataFrame, value: str, km: float, *, cell_cols: Sequence[str]) -> DataFrame:
    """NULL out cells farther than ``km`` from every observation."""
    places = obs.select("lat", "lon").distinct()
    covered = radius_pairs(cells, places, km, cell_cols=cell_cols, point_cols=[], any_point=True)
    flagged = cells.join(covered.withColumn("_in", F.lit(True)).hint("merge"), list(cell_cols), "left")
    return flagged.withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")
