"""Leakage-aware splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import numbered

MIN_DATES = 20


def date_ordinals(df: DataFrame, date: str) -> DataFrame:
    """0-based ordinal of each distinct date (a calendar: bounded by days, not by rows)."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    return days.withColumn("ordinal", F.row_number().over(w) - 1)


def fold_bounds(n: int, folds: int, embargo: int, initial: int, block: int) -> list[tuple[int, int, int, int]]:
    """``(fold, train_end, val_start, val_end)`` over date ordinals; the last fold takes the rest."""
    out, train_end = [], initial
    for i in range(folds):
        start = min(n, train_end + embargo)
        end = n if i == folds - 1 else min(n, start + block)
        if start >= n or end <= start:
            break
        out.append((i + 1, train_end, start, end))
        train_end = end
    return out


def forward_bounds(n: int, folds: int = 3, embargo: int = 1) -> list[tuple[int, int, int, int]]:
    if n < MIN_DATES:
        raise ValueError(f"{n} dates are too few for forward folds")
    initial = max(20, round(0.33 * n))
    return fold_bounds(n, folds, embargo, initial, max(10, round((n - initial) / folds)))


def inner_bounds(n: int, folds: int) -> list[tuple[int, int, int, int]]:
    initial = max(15, round(0.4 * n))
    return fold_bounds(n, folds, 1, initial, max(8, round((n - initial - 1) / folds)))


def _roles(df: DataFrame, date: str, bounds) -> DataFrame:
    days = date_ordinals(df, date)
    parts = []
    for fold, train_end, start, end in bounds:
        role = (F.when(F.col("ordinal") < train_end, "train").when(F.col("ordinal") < start, "embargo")
                .when(F.col("ordinal") < end, "validation"))
        parts.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    rows = days.select(date, F.explode(F.array(*parts)).alias("_f")).select(date, "_f.fold", "_f.role")
    return rows.where(F.col("role").isNotNull())


def forward_folds(df: DataFrame, date: str, n: int = 3, embargo: int = 1) -> DataFrame:
    """Blocked forward folds as ``(date, fold, role)``; role is train, embargo or validation."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct().count()
    return _roles(df, date, forward_bounds(days, n, embargo))


def inner_folds(df: DataFrame, date: str, k: int) -> DataFrame:
    """Forward folds inside a training period."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct().count()
    return _roles(df, date, inner_bounds(days, k))


def lightest_runs(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Where groups go if each, largest first, goes to the lightest of ``k`` folds (the first of equally light ones).

    ``sizes`` are (rows of a group, number of such groups), largest first. Groups of one size are dealt in closed form: with ``rows`` as the
    step, a fold is a level and a remainder; the lowest levels fill up in order of remainder, and from level to level more folds join in.
    Returns per size its runs: the first place (0-based among all groups) and the folds that take turns from there on.
    """
    loads, place, out = [0] * k, 0, []
    for rows, n in sizes:
        level = [load // rows for load in loads]
        steps = sorted(set(level))
        runs, end = [], place + n
        for low, high in zip(steps, [*steps[1:], None]):
            turns = sorted((i for i in range(k) if level[i] <= low), key=lambda i: (loads[i] % rows, i))
            take = end - place if high is None else min(end - place, len(turns) * (high - low))
            runs.append((place, turns))
            for at, i in enumerate(turns):
                loads[i] += rows * (take // len(turns) + (at < take % len(turns)))
            place += take
            if place == end:
                break
        out.append((rows, runs))
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold per group, balanced by rows: ``(group, rows, fold)``.

    Every group, the one with most rows first (ties by key, a NULL key last), goes to the fold with the fewest rows so far. The driver sees how many
    groups have how many rows, at most the root of twice the rows of ``df``; groups are numbered and placed where they lie.
    """
    counts = numbered(df.groupBy(group).agg(F.count(F.lit(1)).alias("rows")), [F.desc("rows"), F.col(group).asc_nulls_last()], "_turn")
    sizes = [(r["rows"], r["n"]) for r in counts.groupBy("rows").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("rows")).collect()]
    k = min(k, sum(n for _, n in sizes))
    if k < 2:
        raise ValueError("at least two groups are needed")
    runs = df.sparkSession.createDataFrame(lightest_runs(sizes, k), "rows long, _runs array<struct<start: long, folds: array<int>>>")
    run = F.element_at(F.filter("_runs", lambda r: r["start"] <= F.col("_turn")), -1)
    placed = counts.join(runs, "rows").withColumn("_run", run)
    turn = F.pmod(F.col("_turn") - F.col("_run.start"), F.size("_run.folds")).cast("int")
    return placed.select(group, "rows", (F.element_at("_run.folds", turn + 1) + 1).alias("fold"))


def group_roles(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """E3 as ``(group, fold, role)`` for every fold."""
    own = group_folds(df, group, k).withColumnRenamed("fold", "_own")
    folds = min(k, own.select("_own").distinct().count())
    rows = own.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return rows.select(group, "fold", F.when(F.col("fold") == F.col("_own"), "validation").otherwise("train").alias("role"))


def leave_one_event_out(df: DataFrame, event: str) -> DataFrame:
    """Per held-out event its rows, and the training events and rows."""
    counts = df.groupBy(event).agg(F.count(F.lit(1)).alias("test_rows"))
    # Events are named storms: a short list by nature.
    whole = counts.agg(F.sort_array(F.collect_list(event)).alias("events"), F.sum("test_rows").alias("n"))
    rows = counts.withColumn("_w", whole.select(F.struct("*")).scalar())
    return rows.select(F.col(event).alias("held_out"), "test_rows", (F.col("_w.n") - F.col("test_rows")).alias("train_rows"),
                       F.array_join(F.array_remove(F.col("_w.events"), F.col(event)), ",").alias("train_events"))


def year_holdout(df: DataFrame, train_years: Sequence[int], test_years: Sequence[int], year="year") -> tuple[DataFrame, DataFrame]:
    """E5: train and test by year; an empty side is an error."""
    train, test = df.where(F.col(year).isin(*train_years)), df.where(F.col(year).isin(*test_years))
    if train.isEmpty() or test.isEmpty():
        raise ValueError("year holdout has an empty side")
    return train, test
