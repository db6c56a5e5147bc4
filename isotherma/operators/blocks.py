"""Everything within a fixed radius, block against block.

The rows asked about have a home, a cube a few radii wide (and a few windows long). Points are copied to the homes within reach, and both sides meet
in one shuffle: the home's rows first, then its points, sorted. A task holds the rows of one home, at most ``HOME_ROWS``, and its points
``CHUNK`` at a time, halves the rows again and again, each half with the points that can matter to it, and compares what is left as numpy arrays.

This is Arrow code because a pair costs some ten nanoseconds here, and some hundreds as a joined row; the pairs are what such a job consists of.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from ..functions.geo import EARTH_RADIUS_KM, unit_xyz
from ..session import stored

HOME_ROWS = 16_384  # more rows of one home are dealt over several keys
CHUNK = 100_000  # points a task holds
SIDE = 3.0  # width of a home in radii
SPAN = 4.0  # and its length in windows
LEAF = 32  # rows that are compared at once
PAIRS = 1 << 17  # pairs that are held at once
SUMMED = 1 << 15  # and when they are summed at once, in as many passes as stay in a core's cache
SLACK = 1e-9
KEY = ["_c0", "_c1", "_c2", "_ct", "_salt"]


def chord(km: float) -> float:
    return 2.0 * np.sin(min(km / (2 * EARTH_RADIUS_KM), np.pi / 2))


def met(rows: DataFrame, points: DataFrame, radius_km: float, *, order: Sequence[str], window_s: float | None = None) -> DataFrame:
    """Rows and points by home: ``KEY``, ``_point`` (0 for the home's rows, which come first), ``_l`` or ``_r`` with the columns, sorted by ``order`` for the points.

    Both have ``lat`` and ``lon`` (and ``t``, seconds, with a window).
    """
    reach = max(float(chord(radius_km)), 1e-7)
    side, names, exprs = SIDE * reach, ["_u0", "_u1", "_u2"], unit_xyz("lat", "lon")
    ids, span = KEY[:3], SPAN * (window_s or 1.0)
    timed = window_s is not None
    placed = lambda df, pack: df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("t").isNotNull() if timed else F.lit(True))).select(
        F.struct(*[F.col(c) for c in df.columns]).alias(pack), *[(e + 1.0).alias(n) for e, n in zip(exprs, names)], (F.col("t") if timed else F.lit(0.0)).alias("_t"))
    cell = lambda u, width: F.floor(F.col(u) / width).cast("long")
    left = placed(rows, "_l").select("_l", *[cell(u, side).alias(c) for u, c in zip(names, ids)], cell("_t", span).alias("_ct"))
    homes = stored(left.groupBy(*KEY[:4]).agg(F.ceil(F.count(F.lit(1)) / HOME_ROWS).cast("int").alias("_salts")), "homes")
    left = left.join(homes, KEY[:4]).select(*KEY[:4], F.pmod(F.xxhash64("_l"), F.col("_salts")).cast("int").alias("_salt"), F.lit(0).alias("_point"), "_l")

    # Copies of a point, one axis at a time: homes whose box it can reach.
    right = placed(points, "_r")
    near = lambda u, width, by: F.sequence(F.floor((F.col(u) - by) / width).cast("long"), F.floor((F.col(u) + by) / width).cast("long"))
    for u, c in zip(names, ids):
        right = right.withColumn(c, F.explode(near(u, side, reach + SLACK)))
    gap2 = sum((F.pow(F.greatest(F.col(c) * side - F.col(u), F.lit(0.0), F.col(u) - (F.col(c) + 1) * side), 2) for u, c in zip(names, ids)), F.lit(0.0))
    right = right.where(gap2 <= (reach + SLACK) ** 2).withColumn("_ct", F.explode(near("_t", span, window_s or 0.0)))
    right = right.join(homes, KEY[:4]).select(*KEY[:4], F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(1).alias("_point"), "_r")
    both = left.withColumn("_r", F.lit(None).cast(right.schema["_r"].dataType)).unionByName(right.withColumn("_l", F.lit(None).cast(left.schema["_l"].dataType)))
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "_point", *[f"_r.{c}" for c in order])


def by_home(df: DataFrame, schema: StructType | str, started: Callable) -> DataFrame:
    """``started(rows)`` gets a home's rows as a struct array and returns ``take(points)`` and ``ended()``, both of which give batches."""
    chunk = CHUNK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, count, take, ended = None, [], [], 0, None, None

        def flushed():
            nonlocal rows, held, count, take, ended
            if rows and held and take is None:
                take, ended = started(pa.concat_arrays(rows))
                rows = []
            if held:
                yield from take(pa.concat_arrays(held)) if take else ()
            held, count = [], 0

        for b in batches:
            ids = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in KEY])
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            sides = b.column("_point").to_numpy(zero_copy_only=False)
            for a, z in itertools.pairwise(cuts):
                if key != (now := tuple(ids[a].tolist())):
                    yield from flushed()
                    if take:
                        yield from ended()
                    key, rows, take, ended = now, [], None, None
                first = a + int(np.searchsorted(sides[a:z], 1))
                if first > a:
                    rows.append(b.column("_l").slice(a, first - a))
                if first < z and (rows or take):
                    held.append(b.column("_r").slice(first, z - first))
                    count += z - first
                    if count >= chunk:
                        yield from flushed()
        yield from flushed()
        if take:
            yield from ended()

    return df.mapInArrow(work, schema)


def numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(rows.type.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)


def places(rows: pa.StructArray, time_scale: float | None = None) -> np.ndarray:
    """Unit vectors, and the time in windows times the radius if there is one."""
    lat, lon = np.radians(numbers(rows, "lat")), np.radians(numbers(rows, "lon"))
    parts = [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]
    return np.column_stack([*parts, *([numbers(rows, "t") * time_scale] if time_scale else [])])


def halved(at: np.ndarray, points: np.ndarray, reach: float, leaf: int = LEAF, nearest: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row numbers, each with the numbers, in order, of the points that can lie within ``reach`` of one of its rows.

    A fourth coordinate is time in the measure of ``reach``. With ``nearest`` only points that can be among so many nearest to a row are kept: the rows
    of a block have that many within the distance of the block's centre to its own, and half the block's diagonal.
    """
    todo = [(np.arange(len(at)), np.arange(len(points)))]
    while todo:
        rows, pts = todo.pop()
        own, other = at[rows], points[pts]
        low, high = own.min(axis=0), own.max(axis=0)
        gap = np.maximum(np.maximum(low - other, other - high), 0.0)
        keep = np.einsum("ij,ij->i", gap[:, :3], gap[:, :3]) <= (reach + SLACK) ** 2
        if at.shape[1] > 3:
            keep &= gap[:, 3] <= reach * (1 + SLACK)
        pts, other = pts[keep], other[keep]
        if nearest and len(pts) > 2 * nearest:
            centre, half = (low + high) / 2, float(np.sqrt((((high - low)[:3] / 2) ** 2).sum()))
            off = other[:, :3] - centre[:3]
            far = np.sqrt(np.einsum("ij,ij->i", off, off))
            sure = far
            if at.shape[1] > 3:
                sure = far[(other[:, 3] >= high[3] - reach * (1 - SLACK)) & (other[:, 3] <= low[3] + reach * (1 - SLACK))]
            if len(sure) >= nearest:
                pts = pts[far <= np.partition(sure, nearest - 1)[nearest - 1] + 2 * half + 2 * SLACK]
        if not len(pts):
            continue
        if len(rows) <= leaf:
            yield rows, pts
            continue
        order = np.argsort(own[:, int((high - low).argmax())], kind="stable")
        todo += [(rows[order[len(rows) // 2 :]], pts), (rows[order[: len(rows) // 2]], pts)]


def kilometres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances of unit vectors, rounded to a millimetre as the joins round them: a row per row of ``a``."""
    out = np.zeros((len(a), len(b)))
    step = np.empty_like(out)
    for i in range(3):
        np.subtract.outer(a[:, i], b[:, i], out=step)
        np.multiply(step, step, out=step)
        out += step
    np.sqrt(out, out=out)
    out *= 0.5
    np.minimum(out, 1.0, out=out)
    np.arcsin(out, out=out)
    out *= 2 * EARTH_RADIUS_KM * 1e6
    np.rint(out, out=out)
    out /= 1e6
    return out


def apart(a: np.ndarray, b: np.ndarray, radius_km: float) -> np.ndarray:
    """Distance of each row of ``a`` to its row of ``b``, beyond the radius infinite."""
    off = a - b
    km = np.rint(2 * EARTH_RADIUS_KM * 1e6 * np.arcsin(np.minimum(np.sqrt((off * off).sum(axis=1)) / 2, 1.0))) / 1e6
    return np.where(km <= radius_km, km, np.inf)


# -- the nearest within a radius and a window -------------------------------------------------------------------------

def nearest_within(rows: DataFrame, points: DataFrame, k: int, radius_km: float, window_s: float, tie: Sequence[str]) -> DataFrame:
    """``_l``, ``_r`` and ``rank``: of each row the ``k`` nearest points, ties by time gap, then by ``tie``. Both have ``lat``, ``lon`` and ``t``."""
    both = met(rows, points, radius_km, order=tie, window_s=window_s)
    reach = float(chord(radius_km))
    scale = reach / window_s if window_s else None
    fields = StructType([both.schema["_l"], both.schema["_r"]]).add("rank", IntegerType())

    def started(own: pa.StructArray):
        at, t = places(own, scale), numbers(own, "t")
        # One row per kept pair: number of the row, distance, gap, and the points themselves.
        best = [np.zeros(0, int), np.zeros(0), np.zeros(0), None]

        def first(i: np.ndarray, km: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((gap, km, i))  # stable: earlier points first
            i = i[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            return order[rank < k], rank[rank < k]

        def take(seen: pa.StructArray):
            to, s = places(seen, scale), numbers(seen, "t")
            found = []
            for block, pts in halved(at, to, reach, nearest=k):
                for begin in range(0, len(pts), part := max(k, PAIRS // len(block))):
                    some = pts[begin : begin + part]
                    km = kilometres(at[block], to[some])
                    gap = np.abs(np.subtract.outer(t[block], s[some]))
                    ok = (km <= radius_km) & (gap <= window_s)
                    if len(some) > k:
                        ok &= km <= np.partition(np.where(ok, km, np.inf), k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(ok)
                    found.append((block[i], km[i, j], gap[i, j], some[j]))
            if found:
                i, km, gap, j = (np.concatenate(x) for x in zip(*found))
                kept, _ = first(i, km, gap)
                i, km, gap, new = i[kept], km[kept], gap[kept], seen.take(pa.array(j[kept]))
                if best[3] is not None:
                    i, km, gap, new = np.concatenate([best[0], i]), np.concatenate([best[1], km]), np.concatenate([best[2], gap]), pa.concat_arrays([best[3], new])
                    kept, _ = first(i, km, gap)
                    i, km, gap, new = i[kept], km[kept], gap[kept], new.take(pa.array(kept))
                best[:] = [i, km, gap, new]
            return ()

        def ended():
            i, km, gap, new = best
            if new is not None:
                kept, rank = first(i, km, gap)
                for begin in range(0, len(kept), 20_000):
                    some = kept[begin : begin + 20_000]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(i[some])), new.take(pa.array(some)), pa.array((rank[begin : begin + 20_000] + 1).astype(np.int32))], names=["_l", "_r", "rank"])

        return take, ended

    return by_home(both, fields, started)


# -- weighted sums within a radius ------------------------------------------------------------------------------------

def weighted_sums(cells: DataFrame, points: DataFrame, values: Sequence[str], radius_km: float, length_km: float) -> DataFrame:
    """Per cell (``_l``) and ``_group`` of the points the sums of ``exp(-(km / length)^2)`` times ``_v_<value>`` and times ``_n_<value>``, the sum of the latter, and the distance
    of the nearest point that has one: ``a_``, ``b_``, ``n_`` and ``k_<value>``. A row per cell and group with a point within the radius.
    """
    both = met(cells, points, radius_km, order=["_group"])
    names = [f"{p}_{v}" for v in values for p in "abnk"]
    fields = StructType([both.schema["_l"]]).add("_group", LongType())
    for n in names:
        fields = fields.add(n, LongType() if n.startswith("n_") else DoubleType())
    reach, width = float(chord(radius_km)), len(values)
    limit = radius_km + 1e-9  # distances are multiples of a millimetre, but for their last digit

    def started(own: pa.StructArray):
        at = places(own)
        state: dict = {"group": None}

        def emptied():
            if state["group"] is not None and state["n"].any():
                hit = np.flatnonzero(state["n"].any(axis=1))
                columns = []
                for v in range(width):
                    far = state["km"][hit, v]
                    columns += [pa.array(state["a"][hit, v]), pa.array(state["b"][hit, v]), pa.array(np.rint(state["n"][hit, v]).astype(np.int64)), pa.array(far, mask=np.isinf(far))]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(hit)), pa.array(np.full(len(hit), state["group"])), *columns], names=["_l", "_group", *names])
            state["group"] = None

        def take(seen: pa.StructArray):
            groups = seen.field(seen.type.get_field_index("_group")).to_numpy(zero_copy_only=False)
            to = places(seen)
            v = np.column_stack([np.nan_to_num(numbers(seen, f"_v_{x}"), posinf=np.inf, neginf=-np.inf) for x in values])
            n = np.column_stack([numbers(seen, f"_n_{x}") for x in values])
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, z in itertools.pairwise(cuts):
                if state["group"] != int(groups[a]):
                    yield from emptied()
                    state.update(group=int(groups[a]), a=np.zeros((len(at), width)), b=np.zeros((len(at), width)), n=np.zeros((len(at), width)), km=np.full((len(at), width), np.inf))
                summed(to[a:z], v[a:z], n[a:z])

        def summed(to: np.ndarray, v: np.ndarray, n: np.ndarray) -> None:
            both = np.column_stack([v, n])
            for block, pts in halved(at, to, reach, leaf=2 * LEAF):
                # Squares of chords by one product of matrices, from the block's middle so that no digits are lost.
                middle = at[block].mean(axis=0)
                own, other = at[block] - middle, to[pts] - middle
                one = np.column_stack([-2 * own, (own * own).sum(axis=1), np.ones(len(own))])
                two = np.column_stack([other, np.ones(len(other)), (other * other).sum(axis=1)])
                for begin in range(0, len(pts), step := max(1, SUMMED // len(block))):
                    some = pts[begin : begin + step]
                    km = one @ two[begin : begin + step].T
                    np.clip(km, 0.0, 4.0, out=km)
                    np.sqrt(km, out=km)
                    km *= 0.5
                    np.arcsin(km, out=km)
                    km *= 2 * EARTH_RADIUS_KM * 1e6
                    np.rint(km, out=km)
                    km *= 1e-6
                    inside = (km <= limit).astype(float)
                    if not inside.any():
                        continue
                    for c in range(width):
                        known = some if (n[some, c] > 0).all() else some[n[some, c] > 0]
                        if len(known):
                            closest = known[(km if known is some else km[:, n[some, c] > 0]).argmin(axis=1)]
                            state["km"][block, c] = np.minimum(state["km"][block, c], apart(at[block], to[closest], radius_km))
                    np.multiply(km, km, out=km)
                    km *= -1.0 / length_km**2
                    np.exp(km, out=km)
                    km *= inside
                    found = km @ both[some]
                    state["a"][block] += found[:, :width]
                    state["b"][block] += found[:, width:]
                    state["n"][block] += inside @ n[some]

        return take, emptied

    return by_home(both, fields, started)
