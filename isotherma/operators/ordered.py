"""Ordered work that survives a hot key.

A plain window over a key sorts all rows of that key in one task. Here the rows of a key are
cut into segments along the sort column; each segment is scanned alone and only one summary
row per segment travels to the key-level window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

SEG = "_seg"


def scan(df: DataFrame, key: Sequence[str], order: str, width: float, *, carry: Sequence[str] = (),
         sums: dict[str, Column] | None = None) -> DataFrame:
    """Previous row, first row and running sums per key.

    Adds ``_seg``; ``_prev`` and ``_head`` (structs of ``order`` and the carried columns of the
    previous and first row, ``_prev`` NULL on the first row) when ``carry`` is given; and one
    inclusive running sum per entry of ``sums``. Ties in ``order`` are broken by the carried
    columns.
    """
    key, sums = list(key), sums or {}
    pack = F.struct(order, *carry)
    base = df.withColumn(SEG, F.floor(F.col(order) / F.lit(float(width))))
    local = Window.partitionBy(*key, SEG).orderBy(order, *carry)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = base.groupBy(*key, SEG).agg(
        F.max(pack).alias("_tail"), F.min(pack).alias("_first"),
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    across = Window.partitionBy(*key).orderBy(SEG)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *key, SEG, F.lag("_tail").over(across).alias("_carry"), F.first("_first").over(across).alias("_head"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    scanned = base.withColumn("_lag", F.lag(pack).over(local))
    for n, e in sums.items():
        scanned = scanned.withColumn(n, F.sum(e).over(running))
    joined = scanned.join(summary, [*key, SEG])
    out = joined.withColumn("_prev", F.coalesce("_lag", "_carry"))
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)) + F.col(f"_t_{n}"))
    return out.drop("_lag", "_carry", *[f"_t_{n}" for n in sums])


def until_first(df: DataFrame, key: Sequence[str], order: str, hit: Column, found: Column,
                sums: dict[str, Column]) -> DataFrame:
    """Per key: the struct ``found`` of the first row where ``hit``, and sums over the rows before it.

    ``df`` comes from :func:`scan`. Adds also ``n_rows``, ``first_row`` and ``last_order``. Sums cover
    every row when nothing is hit.
    """
    key = list(key)
    local = Window.partitionBy(*key, SEG)
    marked = df.withColumn("_hit", hit).withColumn("_found", found)
    marked = marked.withColumn("_at", F.min(F.when(F.col("_hit"), F.col(order))).over(local))
    open_row = F.col("_at").isNull() | (F.col(order) < F.col("_at"))
    per_seg = marked.groupBy(*key, SEG).agg(
        F.min_by("_found", F.when(F.col("_hit"), F.col(order))).alias("_found"),
        F.min("_at").alias("_at"), F.count(F.lit(1)).alias("_n"),
        F.min("_head").alias("_head"), F.max(order).alias("_max"),
        *[F.sum(F.when(open_row, e)).alias(f"_s_{n}") for n, e in sums.items()])
    whole = Window.partitionBy(*key)
    per_seg = per_seg.withColumn("_stop", F.min(F.when(F.col("_at").isNotNull(), F.col(SEG))).over(whole))
    counts = F.col("_stop").isNull() | (F.col(SEG) <= F.col("_stop"))
    return per_seg.groupBy(*key).agg(
        F.min_by("_found", F.when(F.col("_at").isNotNull(), F.col(SEG))).alias("found"),
        F.sum("_n").alias("n_rows"), F.min("_head").alias("first_row"), F.max("_max").alias("last_order"),
        *[F.coalesce(F.sum(F.when(counts, F.col(f"_s_{n}"))), F.lit(0.0)).alias(n) for n in sums])


def value_edges(df: DataFrame, value: str, segments: int = 256) -> list[float]:
    """At most ``segments`` cut points of about equal weight, from a mergeable sketch."""
    probs = [i / segments for i in range(1, segments)]
    row = df.agg(F.percentile_approx(value, probs, segments * 20).alias("e")).first()
    return sorted(set(row["e"] or []))


def value_edges_of(df: DataFrame, values: Sequence[str], segments: int = 256) -> dict[str, list[float]]:
    """:func:`value_edges` of several columns in one pass."""
    probs = [i / segments for i in range(1, segments)]
    row = df.agg(*[F.percentile_approx(v, probs, segments * 20).alias(v) for v in values]).first()
    return {v: sorted(set(row[v] or [])) for v in values}


def with_value_segment(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) == 2:
        return df.withColumn(SEG, F.lit(0.0))
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol=SEG)
    return cut.transform(df.withColumn("_v", F.col(value).cast("double"))).drop("_v")


def running_counts(df: DataFrame, by: Sequence[str], value: str, segments: int = 256) -> DataFrame:
    """One row per distinct value of a group: ``cnt`` rows, ``before`` rows below it, ``total`` rows.

    Equal values are counted first, so a value held by a third of the rows is one row here. No
    task sees more than one segment of a group.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    counts = with_value_segment(counts, value, value_edges(df, value, segments))
    totals = counts.groupBy(*by, SEG).agg(F.sum("cnt").alias("_seg_rows"))
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = across.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, SEG, F.coalesce(F.sum("_seg_rows").over(before), F.lit(0)).alias("_offset"),
                           F.sum("_seg_rows").over(across).alias("total"))
    local = Window.partitionBy(*by, SEG).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("cnt").over(local), F.lit(0)))
    out = counts.join(totals, [*by, SEG])
    return out.select(*by, value, "cnt", (F.col("before") + F.col("_offset")).alias("before"), "total")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    segments: int = 256) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability ``(by, prob, quantile)``."""
    by = list(by)
    counts = running_counts(df, by, value, segments)
    picks = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    # Each distinct value answers the probabilities whose lower or upper rank falls on it.
    rows = counts.select("*", picks)
    position = F.col("prob") * (F.col("total") - 1)
    low, high = F.floor(position), F.ceil(position)
    covers = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("cnt"))
    rows = rows.where(covers(low) | covers(high)).withColumn("_frac", position - low)
    return rows.groupBy(*by, "prob").agg(
        F.max(F.when(covers(low), F.col(value))).alias("_lo"),
        F.max(F.when(covers(high), F.col(value))).alias("_hi"), F.max("_frac").alias("_frac"),
    ).select(*by, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"))


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float],
                     segments: int = 256) -> DataFrame:
    """Quantiles as columns, one row per group."""
    q = exact_quantiles(df, by, value, list(named.values()), segments)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n)
                                for n, p in named.items()])


def average_ranks(df: DataFrame, value: str, out: str, segments: int = 256) -> DataFrame:
    """Attach the average rank of each row (ties share one rank)."""
    ranks = running_counts(df, [], value, segments)
    ranks = ranks.select(value, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(out))
    return df.join(ranks, value)


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """A 0-based row number in any order, without sorting in one task.

    Rows are range-partitioned and numbered where they lie; what is added to each is summed over one row per partition. The numbered
    rows are written to the shared folder, so that a task that runs again sees the same ranges.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    joined = rows.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_id")


def row_positions(df: DataFrame, order: str, out: str = "position", segments: int = 256) -> DataFrame:
    """0-based global position by a unique, numeric order column."""
    pos = running_counts(df, [], order, segments).select(order, F.col("before").alias(out))
    return df.join(pos, order)
