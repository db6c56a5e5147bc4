"""Ridge regressions of many feature sets and folds from shared moments.

One pass over the rows sums, for each fold's training rows, counts, sums and products of all features and the label. Any subset of the features is then
solved from a part of these moments, so a hundred feature sets cost one pass more: that of their predictions, all at once. What comes to the
driver is a features-by-features table per fold, whatever the rows.

Features and label are moved by their overall means before products are summed, so that no digits are lost. A missing feature is the exact median of the
fold's training rows (M1). The penalty ``alpha`` is on the summed squares of slopes, the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import error_metrics
from .ordered import exact_quantiles


@dataclass(frozen=True)
class Moments:
    """Per fold the Gram matrix of (1, features, label), moved by ``shift``; ``fills`` are the moved medians."""

    features: list[str]
    shift: np.ndarray
    fills: np.ndarray
    grams: np.ndarray

    def solve(self, fold: int, subset: Sequence[str], alpha: float = 1.0) -> tuple[np.ndarray, float]:
        """Slopes over all features (0 outside the subset) and the intercept, both for moved features and label."""
        gram = self.grams[fold]
        at = np.array([self.features.index(f) + 1 for f in subset])
        slopes, n = np.zeros(len(self.features)), gram[0, 0]
        if n == 0:
            return slopes, 0.0
        mean, label = gram[0, at] / n, gram[0, -1] / n
        spread = gram[np.ix_(at, at)] - n * np.outer(mean, mean)
        slopes[at - 1] = np.linalg.solve(spread + alpha * np.eye(len(at)), gram[at, -1] - n * mean * label)
        return slopes, float(label - slopes[at - 1] @ mean)


def medians(df: DataFrame, features: Sequence[str], training: Sequence[str]) -> dict[tuple[str, str], float]:
    """(fold's column, feature) -> exact median of its training rows, for features that have missing values."""
    nulls = df.agg(*[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features]).first()
    lacking = [f for f in features if nulls[f]]
    if not lacking:
        return {}
    folds = F.explode(F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in training]), lambda x: x.isNotNull())).alias("fold")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in lacking])).alias("_p")
    long = df.select(folds, *lacking).select("fold", values).select("fold", "_p.feature", "_p.value").where("value IS NOT NULL AND NOT isnan(value)")
    return {(r["fold"], r["feature"]): r["quantile"] for r in exact_quantiles(long, ["fold", "feature"], "value", [0.5]).collect()}


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])


def _inputs(features: Sequence[str]) -> list:
    return [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]


def moments(df: DataFrame, features: Sequence[str], label: str, training: Sequence[str]) -> Moments:
    """``training`` names boolean columns, one per fold. Rows without label are left out."""
    features = list(features)
    rows = df.where(F.col(label).isNotNull())
    means = rows.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}") for i, c in enumerate([*features, label])]).first()
    shift = np.array([m or 0.0 for m in means])
    known = medians(rows, features, training)
    fills = np.array([[known.get((t, f), shift[i]) - shift[i] for i, f in enumerate(features)] for t in training])
    width, xs = len(features) + 2, [f"_x{i}" for i in range(len(features))]
    picked = rows.select(*_inputs(features), F.col(label).cast("double").alias("_y"), *[F.coalesce(t, F.lit(False)).alias(f"_t{k}") for k, t in enumerate(training)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(training), width, width))
        for b in batches:
            x = _matrix(b, [*xs, "_y"]) - shift
            for k in range(len(training)):
                own = x[b.column(f"_t{k}").to_numpy(zero_copy_only=False).astype(bool)]
                own[:, :-1] = np.where(np.isnan(own[:, :-1]), fills[k], own[:, :-1])
                full = np.column_stack([np.ones(len(own)), own])
                total[k] += full.T @ full
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "value": total.ravel()})

    sums = np.zeros(len(training) * width * width)
    for r in picked.mapInArrow(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # folds x features^2 rows
        sums[r["at"]] = r["value"]
    return Moments(features, shift, fills, sums.reshape(len(training), width, width))


def _solutions(m: Moments, sets: dict[str, Sequence[str]], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes (fold, feature, set) and intercepts (fold, set), the label's shift added."""
    found = [[m.solve(k, s, alpha) for s in sets.values()] for k in range(len(m.grams))]
    return np.array([[s for s, _ in f] for f in found]).transpose(0, 2, 1), np.array([[c for _, c in f] for f in found]) + m.shift[-1]


def _scored(b: pa.RecordBatch, m: Moments, slopes: np.ndarray, free: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
    x = _matrix(b, [f"_x{i}" for i in range(len(m.features))])[rows] - m.shift[:-1]
    return np.where(np.isnan(x), m.fills[k], x) @ slopes[k] + free[k]


def predictions(df: DataFrame, m: Moments, sets: dict[str, Sequence[str]], validation: Sequence[str], base: str, *, keep: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """A row per row, fold that validates it and feature set: the kept columns, fold (from 0), feature_set and pred."""
    slopes, free = _solutions(m, sets, alpha)
    names = np.array(list(sets))
    picked = df.select(*keep, *_inputs(m.features), F.col(base).cast("double").alias("_base"), *[F.coalesce(t, F.lit(False)).alias(f"_v{k}") for k, t in enumerate(validation)])
    schema = df.select(*keep, F.lit(0).alias("fold"), F.lit("").alias("feature_set"), F.lit(0.0).alias("pred")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base_value = b.column("_base").to_numpy(zero_copy_only=False).astype(float)
            for k in range(len(validation)):
                rows = np.flatnonzero(b.column(f"_v{k}").to_numpy(zero_copy_only=False).astype(bool))
                if not len(rows):
                    continue
                pred = _scored(b, m, slopes, free, k, rows) + base_value[rows, None]
                again = pa.array(np.repeat(rows, len(names)))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(again) for c in keep], pa.array(np.full(len(again), k, np.int32)), pa.array(np.tile(names, len(rows)).tolist(), pa.string()), pa.array(pred.ravel())],
                    names=[*keep, "fold", "feature_set", "pred"])

    return picked.mapInArrow(work, schema)


def mean_errors(df: DataFrame, m: Moments, sets: dict[str, Sequence[str]], validation: Sequence[str], label: str, alpha: float = 1.0) -> dict[str, float]:
    """Mean absolute error of each set over all validation rows; tasks hand on one row per set."""
    slopes, free = _solutions(m, sets, alpha)
    picked = df.where(F.col(label).isNotNull()).select(*_inputs(m.features), F.col(label).cast("double").alias("_y"), *[F.coalesce(t, F.lit(False)).alias(f"_v{k}") for k, t in enumerate(validation)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sets)), 0
        for b in batches:
            y = b.column("_y").to_numpy(zero_copy_only=False)
            for k in range(len(validation)):
                rows = np.flatnonzero(b.column(f"_v{k}").to_numpy(zero_copy_only=False).astype(bool))
                total += np.abs(_scored(b, m, slopes, free, k, rows) - y[rows, None]).sum(axis=0)
                n += len(rows)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(sets)), "total": total, "n": np.full(len(sets), n)})

    rows = picked.mapInArrow(work, "at long, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mae")).collect()
    found = {r["at"]: r["mae"] for r in rows}
    return {name: found[k] for k, name in enumerate(sets)}


def ablation(df: DataFrame, folds: Sequence[int], sets: dict[str, Sequence[str]], *, obs: str, base: str, split: str = "forward", target: str = "tchp", alpha: float = 1.0) -> DataFrame:
    """M8, M9: out-of-fold metrics of every feature set. ``df`` has a column ``role_<fold>`` for each fold."""
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull()).withColumn("_delta", F.col(obs) - F.col(base))
    for f in folds:
        rows = rows.withColumn(f"_train_{f}", F.col(f"role_{f}") == "train").withColumn(f"_val_{f}", F.col(f"role_{f}") == "validation")
    features = list(dict.fromkeys(c for s in sets.values() for c in s))
    m = moments(rows, features, "_delta", [f"_train_{f}" for f in folds])
    long = predictions(rows, m, sets, [f"_val_{f}" for f in folds], base, keep=[obs], alpha=alpha)
    found = error_metrics(long, obs, "pred", None, ["feature_set"])
    return found.select(F.lit(target).alias("target"), F.lit(split).alias("split"), "feature_set", *[c for c in found.columns if c != "feature_set"])


def elimination(df: DataFrame, folds: Sequence[int], features: Sequence[str], *, obs: str, base: str, keep: int = 4, alpha: float = 1.0) -> DataFrame:
    """Drop again and again the feature without which the out-of-fold error is lowest. One pass per step tries all."""
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull()).withColumn("_delta", F.col(obs) - F.col(base))
    for f in folds:
        rows = rows.withColumn(f"_train_{f}", F.col(f"role_{f}") == "train").withColumn(f"_val_{f}", F.col(f"role_{f}") == "validation")
    m = moments(rows, features, "_delta", [f"_train_{f}" for f in folds])
    validation = [f"_val_{f}" for f in folds]
    current = list(features)
    trail = [(0, "", len(current), mean_errors(rows, m, {"": current}, validation, "_delta", alpha)[""])]
    while len(current) > keep:
        tried = mean_errors(rows, m, {f: [c for c in current if c != f] for f in current}, validation, "_delta", alpha)
        worst = min(tried, key=lambda f: (tried[f], f))
        current.remove(worst)
        trail.append((len(trail), worst, len(current), tried[worst]))
    return df.sparkSession.createDataFrame(trail, "step int, removed string, n_features int, mae double")


def held_out(df: DataFrame, sides: dict[str, tuple[Column, Column]], features: Sequence[str], *, obs: str, base: str, keep: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """(keep, obs, base, split, pred) of the rows that each split holds out, by a model of its training rows.

    ``sides`` has the conditions for training and held-out rows of each split. All splits share two passes. A split with an empty side is an error.
    """
    rows = df.where(F.col(obs).isNotNull() & F.col(base).isNotNull()).withColumn("_delta", F.col(obs) - F.col(base))
    rows = rows.withColumns({f"_{k}_{i}": F.coalesce(c, F.lit(False)) for i, pair in enumerate(sides.values()) for k, c in zip(("train", "val"), pair)})
    train, val = ([f"_{k}_{i}" for i in range(len(sides))] for k in ("train", "val"))
    sizes = rows.agg(*[F.count_if(c).alias(c) for c in (*train, *val)]).first().asDict()
    empty = [name for i, name in enumerate(sides) if not sizes[train[i]] or not sizes[val[i]]]
    if empty:
        raise ValueError(f"splits with an empty side: {empty}")
    found = predictions(rows, moments(rows, features, "_delta", train), {"": features}, val, base, keep=list(dict.fromkeys([*keep, obs, base])), alpha=alpha)
    names = F.array(*[F.lit(n) for n in sides])
    return found.withColumn("split", F.get(names, F.col("fold"))).drop("fold", "feature_set")


def leave_one_event_out(df: DataFrame, event: str, features: Sequence[str], *, obs: str, base: str, alpha: float = 1.0) -> DataFrame:
    """For each event the errors of the raw value and of a model that was fitted without it. Rows without an event only train."""
    names = sorted(r[0] for r in df.where(F.col(event).isNotNull()).select(event).distinct().collect())  # named storms: a short list
    sides = {n: (~F.col(event).eqNullSafe(F.lit(n)), F.col(event).eqNullSafe(F.lit(n))) for n in names}
    out = held_out(df, sides, features, obs=obs, base=base, alpha=alpha)
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col(obs)))
    return out.groupBy(F.col("split").alias("held_out")).agg(F.count(F.lit(1)).alias("rows"), mae(base).alias("raw_mae"), mae("pred").alias("mae"), F.avg(F.col("pred") - F.col(obs)).alias("bias"))
