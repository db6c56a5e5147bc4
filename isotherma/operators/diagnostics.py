"""Distribution and feature diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import units_of
from .ordered import average_ranks, exact_quantiles, quantile_columns, running_counts, value_edges_of

VIF_INFINITE_R2 = 0.999999
# Upper bounds and steps of rounded axis limits.
AXIS_STEPS = ((20, 2), (100, 10), (250, 25))
AXIS_LAST_STEP = 50


def _one(df: DataFrame):
    """A one-row frame as a struct column."""
    return df.select(F.struct("*")).scalar()


def _bin(value, low, high, bins: int):
    """Equal-width bin of a closed range; NULL outside it."""
    v = F.col(value) if isinstance(value, str) else value
    index = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when(v.between(low, high), index.cast("int"))


def density2d(df: DataFrame, x: str, y: str, xlim: tuple[float, float], ylim: tuple[float, float], bins: int = 80) -> DataFrame:
    """log10 share of each occupied cell of a 2-D histogram."""
    rows = df.select(_bin(x, *map(F.lit, xlim), bins).alias("ix"), _bin(y, *map(F.lit, ylim), bins).alias("iy")).dropna()
    cells = rows.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cells.select("ix", "iy", "n", F.log10(F.col("n") / total).alias("log_share"))


def density_limits(density: DataFrame, value: str = "log_share", pad: float = 0.03) -> DataFrame:
    """Padded colour limits over occupied cells; a single value is padded by 0.25, none gives (-1, 0)."""
    lo, hi = F.min(value), F.max(value)
    margin = F.when(F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi), F.lit(0.25)).otherwise(pad * (hi - lo))
    return density.agg(F.coalesce(lo - margin, F.lit(-1.0)).alias("vmin"), F.coalesce(hi + margin, F.lit(0.0)).alias("vmax"))


def error_pdf(errors: DataFrame, series: str, error: str, edges: int = 80, q: float = 0.995) -> DataFrame:
    """Density of each error series over a common range of plus and minus the q-quantile of |error|."""
    rows = errors.where(F.col(error).isNotNull())
    bound = exact_quantiles(rows.withColumn("_a", F.abs(error)), [], "_a", [q]).select("quantile").scalar()
    bins = edges - 1
    rows = rows.withColumn("_q", bound)
    rows = rows.select(series, "_q", _bin(error, -F.col("_q"), F.col("_q"), bins).alias("bin")).where("bin IS NOT NULL")
    counts = rows.groupBy(series, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("_q").alias("_q"))
    total = F.sum("n").over(Window.partitionBy(series))  # at most ``edges`` rows per series
    width = 2 * F.col("_q") / bins
    return counts.select(series, "bin", (-F.col("_q") + F.col("bin") * width).alias("bin_lo"), "n", (F.col("n") / total / width).alias("density"))


def error_cdf(errors: DataFrame, series: str, error: str) -> DataFrame:
    """Share of rows at or below each distinct |error|."""
    rows = errors.where(F.col(error).isNotNull()).withColumn("abs_error", F.abs(error))
    counts = running_counts(rows, [series], "abs_error")
    return counts.select(series, "abs_error", ((F.col("before") + F.col("cnt")) / F.col("total")).alias("fraction"))


def error_spread(errors: DataFrame, series: str, error: str) -> DataFrame:
    """Population deviation of each error series."""
    return errors.groupBy(series).agg(F.stddev_pop(error).alias("error_std"))


def nice_upper(v):
    """Round an upper limit up to a step that suits its size; 1 for missing or non-positive values."""
    step = None
    for bound, s in AXIS_STEPS:
        step = F.when(v <= bound, F.lit(s)) if step is None else step.when(v <= bound, F.lit(s))
    step = step.otherwise(F.lit(AXIS_LAST_STEP))
    return F.when(v > 0, (F.ceil(v / step) * step).cast("double")).otherwise(F.lit(1.0))


def axis_limits(values: DataFrame, value: str) -> DataFrame:
    """Shared axis limits of several series given in long form."""
    q = quantile_columns(values, [], value, {"_lo": 0.001, "_hi": 0.995})
    return q.select(F.least(F.lit(0.0), "_lo").alias("lower"), nice_upper(F.col("_hi")).alias("upper"))


def value_limits(df: DataFrame, value: str, *, signed: bool = False, log_scale: bool = False) -> DataFrame:
    """Colour limits between the 5 % and 95 % quantiles: symmetric if signed, positive if logarithmic."""
    rows = df.where(F.col(value) > 0) if log_scale else df
    q = quantile_columns(rows, [], value, {"lo": 0.05, "hi": 0.95})
    if log_scale:
        return q
    if signed:
        bound = F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1e-12))
        return q.select((-bound).alias("lo"), bound.alias("hi"))
    return q.select("lo", F.when(F.col("lo") == F.col("hi"), F.col("hi") + 1.0).otherwise(F.col("hi")).alias("hi"))


def columns_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per value: ``(keep, column_name, value)``."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.column_name", "_e.value")


def feature_inventory(df: DataFrame, columns: Sequence[str], date: str, recipe: Sequence[str] = (), families: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Coverage, dates, quantiles, unit and family of each column; the family is the name of the first list of ``families`` that has it."""
    long = columns_long(df, columns, [date])
    valid = F.col("value").isNotNull()
    base = long.groupBy("column_name").agg(
        F.count("value").alias("valid_rows"), (100.0 * F.count("value") / F.count(F.lit(1))).alias("valid_pct"),
        F.min(F.when(valid, F.col(date))).cast("string").alias("first_date"), F.max(F.when(valid, F.col(date))).cast("string").alias("last_date"),
        F.countDistinct(F.when(valid, F.col(date))).alias("valid_dates"))
    q = quantile_columns(long, ["column_name"], "value", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    out = base.join(q, "column_name", "left")
    family = F.coalesce(*[F.when(F.col("column_name").isin(*members), F.lit(name)) for name, members in (families or {}).items()], F.lit(None).cast("string"))
    return out.select("*", units_of("column_name").alias("units"), family.alias("family"), F.col("column_name").isin(*recipe or [""]).cast("int").alias("in_recipe"))


def correlation_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson and Spearman correlation of each feature with the target, on rows complete for all columns.

    The target is ranked once. All features are then ranked together in long form: rows with one value of a feature become its count and
    the sum of their target ranks, which is all that the rank products need, so nothing is joined back to the rows whatever the number of features.
    """
    rows = average_ranks(df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_t")).dropna(), "_t", "_rt")
    pearson = [F.struct(F.lit(f).alias("feature"), F.corr(f, "_t").alias("pearson")) for f in features]
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.var_pop("_rt").alias("_vt"), F.array(*pearson).alias("_p"))
    whole = whole.select("rows", "_vt", F.explode("_p").alias("_e")).select("_e.*", "rows", "_vt")
    edges = value_edges_of(rows, features)
    cut = Bucketizer(inputCols=list(features), outputCols=[f"_seg_{f}" for f in features],
                     splitsArray=[[float("-inf"), *(edges[f] or [0.0]), float("inf")] for f in features])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"_seg_{f}").alias("_seg"), F.col(f).alias("value")) for f in features]
    long = cut.transform(rows).select("_rt", F.explode(F.array(*entries)).alias("_e")).select("_e.*", "_rt")
    values = long.groupBy("feature", "_seg", "value").agg(F.count(F.lit(1)).alias("_n"), F.sum("_rt").alias("_srt"))
    segments = values.groupBy("feature", "_seg").agg(F.sum("_n").alias("_all"))
    below = Window.partitionBy("feature").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    of = Window.partitionBy("feature")
    segments = segments.select("feature", "_seg", F.coalesce(F.sum("_all").over(below), F.lit(0)).alias("_below"), F.sum("_all").over(of).alias("_total"))
    inside = Window.partitionBy("feature", "_seg").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(segments, ["feature", "_seg"])
    middle = (F.col("_total") + 1) / 2.0  # ranks are taken from their mean, so that large tables lose no digits
    off = F.col("_below") + F.col("_in") + (F.col("_n") + 1) / 2.0 - middle
    sums = ranked.groupBy("feature").agg(F.sum(off * (F.col("_srt") - F.col("_n") * middle)).alias("_xy"), F.sum(F.col("_n") * off * off).alias("_xx"))
    spearman = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_vt") * F.col("rows")), F.lit(0.0))
    return whole.join(sums, "feature").select("feature", "pearson", spearman.alias("spearman"), "rows")


def feature_corr_matrix(df: DataFrame, features: Sequence[str], cutoff: float = 0.0) -> DataFrame:
    """Pairwise-complete Pearson correlation of feature pairs, all in one pass; pairs at or above the cut-off."""
    pairs = list(combinations(features, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(entries).alias("_e")).select("_e.*").where(F.abs("corr") >= cutoff)


def vif(df: DataFrame, features: Sequence[str], intercept: bool = False) -> DataFrame:
    """Variance inflation of each feature. The Gram matrix is summed by Spark; a features-by-features matrix is solved here."""
    rows = df.select(*features).dropna()
    m = len(features)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(m):
        aggs.append(F.sum(F.col(features[i]).cast("double")).alias(f"s{i}"))
        aggs += [F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"g{i}_{j}") for j in range(i, m)]
    got = rows.agg(*aggs).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], dtype=float)
    sums = np.array([got[f"s{i}"] for i in range(m)], dtype=float)
    # The R2 is centred when the regression has an intercept, else uncentred.
    if intercept:
        gram = gram - np.outer(sums, sums) / got["n"]
    out = []
    for i, name in enumerate(features):
        rest = [j for j in range(m) if j != i]
        beta = np.linalg.lstsq(gram[np.ix_(rest, rest)], gram[rest, i], rcond=None)[0]
        r2 = float(beta @ gram[rest, i] / gram[i, i])
        out.append((name, float("inf") if r2 >= VIF_INFINITE_R2 else 1.0 / (1.0 - r2)))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


def histogram1d(df: DataFrame, value: str, bins: int = 40, positive_only: bool = False) -> DataFrame:
    """Equal-width histogram over the data range."""
    rows = df.where(F.col(value).isNotNull())
    if positive_only:
        rows = rows.where(F.col(value) > 0)
    span = _one(rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")))
    rows = rows.select(value, span.alias("_s"))
    rows = rows.select(_bin(value, F.col("_s.lo"), F.col("_s.hi"), bins).alias("bin"), "_s")
    out = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("_s").alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return out.select("bin", (F.col("_s.lo") + F.col("bin") * width).alias("bin_lo"), "n")
