"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of the target (documents labelled good) and one of the raw text (all
documents). A document's log importance weight is the sum over its n-grams of the log ratio of the two models. Gumbel noise is added and
the k highest are kept, which samples k documents without replacement by importance.

n-grams are 3 and 5 bytes of the lower-cased text with white space runs as one space, and pairs of successive words; a word that
repeats the one before counts by how often it has been repeated in a row. A model holds the share of documents that have an n-gram, so copies within a
text do not sway it. Log ratios are drawn towards 0 by their own standard error and those above 0 count as 0, so weight is lost by what the
target does not have. A text of more than 1000 bytes gets the weight of 1000 bytes of it on average; else noise would add up over long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .store import mixed, slices, stream, texts
from .words import hashed_words

BUCKET_BITS = 22  # bounds both models: 2^22 buckets; 16 MB are broadcast
GRAMS = (3, 5)  # bytes
RUNS = 8  # repeats of a word in a row that are told apart
ERRORS = 1.5  # standard errors by which a log ratio is drawn towards 0
TYPICAL = 1_000  # bytes; longer texts are weighed per so many
PRIOR = 0.5  # added to a count of documents
BROADCAST_LABELS = 1_000_000  # ids; more are joined by a shuffle
LABELS = 200_000  # at most so many labelled documents set the cut; the models count all
TABLE = stream(256, 81)
POWERS = stream(max(GRAMS), 82) | np.uint64(1)
SPACE = np.uint8(32)
SHIFT = np.uint64(64 - BUCKET_BITS)


def features(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the buckets of all that occur, and the text each is of, ordered by text."""
    words = hashed_words(rows)
    h, owner = words.hashes, words.owner
    same = owner[1:] == owner[:-1]
    again = (h[1:] == h[:-1]) & same
    at = np.arange(len(h))
    first = np.concatenate([[True], ~again])[: len(h)]
    run = at - np.maximum.accumulate(np.where(first, at, 0)) if len(h) else at
    pair = mixed(h[1:] * POWERS[0] + h[:-1] * POWERS[1], 83)
    pair[again] = mixed(np.minimum(run[1:][again], RUNS).astype(np.uint64), 84)
    out = [((pair[same] >> SHIFT).astype(np.int64), owner[1:][same])]
    keep = ~(words.white & np.concatenate([[False], words.white[:-1]]))  # one space for a run
    values = TABLE[np.where(words.white, SPACE, words.data)[keep]]
    ends = np.concatenate([[0], np.cumsum(keep)])[words.text_ends] if len(keep) else np.zeros(len(rows), np.int64)
    own = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
    for size in GRAMS:
        n = max(0, len(values) - size + 1)
        gram = np.zeros(n, np.uint64)
        for k in range(size):
            gram += values[k : k + n] * POWERS[k]
        inside = own[:n] == own[size - 1 :][:n]
        out.append(((mixed(gram, 85 + size)[inside] >> SHIFT).astype(np.int64), own[:n][inside]))
    return out


def once_per_text(buckets: np.ndarray, owner: np.ndarray, n: int, stamps: np.ndarray) -> np.ndarray:
    """Which of the buckets are the last of their kind in their text. ``stamps`` is scratch space of one number per bucket."""
    edges = np.searchsorted(owner, np.arange(n + 1))
    last = np.zeros(len(buckets), bool)
    for a, b in zip(edges, edges[1:]):
        own, place = buckets[a:b], np.arange(b - a)
        stamps[own] = place
        last[a:b] = stamps[own] == place
    return last


def bucket_counts(docs: DataFrame, flag: Column, text_col: str = "text") -> DataFrame:
    """(bucket, n, good): documents that have an n-gram of the bucket, and those of them with the flag. At most 2^22 rows.

    Every task sums its own texts first, so what is shuffled is bounded by tasks times buckets.
    """
    flagged = docs.select(text_col, F.coalesce(flag, F.lit(False)).alias("_flag"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        total, good, stamps = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for batch in batches:
            rows, flags = texts(batch.column(0)), np.asarray(batch.column(1).to_pylist(), bool)
            for a, b in slices(rows):
                for bucket, owner in features(rows[a:b]):
                    once = once_per_text(bucket, owner, b - a, stamps)
                    np.add.at(total, bucket[once], 1)
                    np.add.at(good, bucket[once & flags[a:b][owner]], 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part, pa.int32()), "n": pa.array(total[part]), "good": pa.array(good[part])})

    counts = flagged.mapInArrow(count, "bucket int, n int, good int")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw for each bucket, as 32-bit floats, none above 0."""

    ratios: np.ndarray

    def scores(self, rows: list[bytes]) -> np.ndarray:
        total = np.zeros(len(rows))
        for bucket, owner in features(rows):
            total += np.bincount(owner, self.ratios[bucket], minlength=len(rows))
        return total * np.minimum(1, TYPICAL / np.maximum(1, np.array([len(x) for x in rows])))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Models of all documents and of those labelled good (quality 1, toxic 0). Labels join on doc_id."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_good")).distinct()
    if good.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    flagged = docs.join(good, F.col("doc_id") == F.col("_good"), "left")
    flag = F.col("_good").isNotNull()
    n_docs, n_good = flagged.agg(F.count("*"), F.count("_good")).first()
    ratios = np.zeros(1 << BUCKET_BITS, np.float32)
    # the model comes in pieces of at most 2^22 rows altogether, of which only the ratios below 0 are taken
    counts = stored(bucket_counts(flagged, flag), "importance-counts")
    ratio = (F.log((F.col("good") + PRIOR) / (n_good + 2 * PRIOR)) - F.log((F.col("n") + PRIOR) / (n_docs + 2 * PRIOR))
             + ERRORS * F.sqrt(1 / (F.col("good") + PRIOR) + 1 / (F.col("n") + PRIOR)))
    if n_good:
        found = counts.select("bucket", ratio.cast("float").alias("ratio")).where("ratio < 0").toArrow()
        ratios[found.column("bucket").to_numpy()] = found.column("ratio").to_numpy()
    return Model(ratios)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the log importance weight. NULL and empty texts have no n-grams and a score of 0.

    A column named ``score`` is replaced; all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.ratios)  # 16 MB, whatever the data
    kept = docs.drop("score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                rows = texts(batch.column(text_col))
                found = [own.scores(rows[a:b]) for a, b in slices(rows)]
                arrays = [batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(found) if found else [], pa.float64())],
                                                 names=[*batch.schema.names, "score"])

    return kept.mapInArrow(score, kept.withColumn("score", F.lit(0.0)).schema)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise, fixed by seed and keys."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The score from which on documents are taken for target-like: the best balanced accuracy; ties go to the lower score."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    kept_good = 1 - np.concatenate([[0], np.cumsum(g)[:-1]]) / g.sum()
    left_bad = np.concatenate([[0], np.cumsum(~g)[:-1]]) / (~g).sum()
    value = np.where(np.concatenate([[True], s[1:] > s[:-1]]), kept_good + left_bad, -1)
    k = int(value.argmax())
    return float((s[k] + s[k - 1]) / 2) if k else -np.inf


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of column ``_key``, exactly, by histograms of at most 4096 bins; None if there are fewer rows.

    ``keys`` should be stored: it is read once per round.
    """
    low, high, n, top = keys.agg(F.min("_key"), F.max("_key"), F.count("_key"), F.lit(0)).first()
    if k <= 0 or n is None or n <= k:
        return None
    above = 0
    while low < high:
        step = (high - low) / 4096
        if low + step == low or high - step == high:
            break
        at = F.least(F.floor((F.col("_key") - low) / step), F.lit(4095))
        rows = keys.where(F.col("_key").between(low, high)).groupBy(at.alias("b")).agg(
            F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()  # at most 4096 rows
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return float(low if low == high else high)


@dataclass(frozen=True)
class Decision:
    model: Model
    least: float | None  # the smallest key that is kept; None: all are kept
    scores: DataFrame  # doc_id, score, gumbel_key; stored

    def kept(self, key: str = "gumbel_key") -> Column:
        return F.lit(True) if self.least is None else F.col(key) >= F.lit(self.least)


def keyed(docs: DataFrame, model: Model, seed: int) -> DataFrame:
    return scored(docs.drop("gumbel_key"), model).withColumn("gumbel_key", F.col("score") + gumbel(seed, F.col("doc_id"), F.col("text")))


def decide(docs: DataFrame, labels: DataFrame, seed: int = 29) -> Decision:
    """Fit the models, score all documents and find the key of the k-th.

    ``k`` is the number of documents whose score is target-like; that cut is fitted on at most ``LABELS`` labelled documents (those
    with the smallest hash of the id; the models count all). NULL ids are ids like any other but have no label. Without labels, or without
    good or bad ones, all stay.
    """
    model = fit(docs, labels)
    scores = stored(keyed(docs.select("doc_id", "text"), model, seed).select("doc_id", "score", "gumbel_key"), "importance-scores")
    flags = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.expr("quality = 1 AND coalesce(toxic, 0) = 0")).alias("good"))
    known = scores.join(flags, "doc_id").orderBy(F.xxhash64("doc_id")).limit(LABELS).select("score", "good").toArrow()
    cut = best_cut(known.column("score").to_numpy(), known.column("good").to_numpy(zero_copy_only=False).astype(bool)) if len(known) else -np.inf
    k = scores.where(F.col("score") >= F.lit(float(cut))).count()
    return Decision(model, threshold(scores.withColumnRenamed("gumbel_key", "_key"), k), scores)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 29) -> DataFrame:
    """``docs`` with score, gumbel_key and kept: the k documents with the highest score plus noise.

    Documents tied at the k-th place are all kept. Rows that repeat id and text get the same noise, so they stay or go together. An
    empty table gives an empty result. Columns with the names of the new ones are replaced.
    """
    kept = docs.drop("score", "gumbel_key", "kept")
    decision = decide(kept, labels, seed)
    return keyed(kept, decision.model, seed).withColumn("kept", decision.kept())
