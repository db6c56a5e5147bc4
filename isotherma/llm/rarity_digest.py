"""Improbable-feature digests.

Every 64-byte window of a text is ranked by how rare its entropy is: the rarer its level among all windows of the corpus, the better its
rank. In each run of 64 consecutive windows the best-ranked one gets a vote; windows with 16 votes or more are features. Their
hashes go into Bloom filters of 256 bytes, 160 features to a filter, then the next is begun. Two digests are compared
filter by filter by the overlap of their bits, normalised so that the overlap expected by chance is 0 and the most possible is 1.

The rank table comes from all windows of all documents and is part of the digest's parameters: digests compare only under one table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import mixed, slices, stream, texts

WINDOW = 64  # bytes
RUN = 64  # windows
VOTES = 16
FILTER_BITS = 2048
HASHES = 5
FEATURES = 160  # of a filter
LEVELS = 1024  # of entropy
SCALE = 1 << 20
BLOCK = 1 << 20  # bytes of one text that are worked on at once


def _plog() -> np.ndarray:
    """c log2 c for counts 0..64 in fixed point."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    return np.rint(c * np.log2(np.maximum(c, 1)) * SCALE).astype(np.int64)


PLOG = _plog()
STEP = np.diff(PLOG)  # gain of the count c -> c + 1
TOP = int(PLOG[WINDOW])
POWERS = stream(WINDOW, 41) | np.uint64(1)
BYTES = stream(256, 42)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of each window's entropy, 0 to 1023; one for each start of a window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = data[lag:] == data[:-lag]
        before[lag:] += same
        after[:-lag] += same
    # sums of c log c: the first window from its counts, the others by what enters and what leaves
    first = int(PLOG[np.bincount(data[:WINDOW], minlength=256)].sum())
    delta = STEP[before[WINDOW:]] - STEP[after[: n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(delta)])
    return ((TOP - total) * (LEVELS - 1) // TOP).astype(np.int16)


def windows_of(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of a text with their first window, such that every window is in exactly one block."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        part = data[at : at + BLOCK + WINDOW - 1]
        yield at, part, entropy_levels(part)


def level_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(level, n): windows of all documents by level of entropy; at most 1024 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            rows = texts(batch.column(0))
            for a, b in slices(rows):
                if b - a == 1:
                    for _, _, levels in windows_of(rows[a]):
                        total += np.bincount(levels, minlength=LEVELS)
                    continue
                data, inside = _joined(rows[a:b])
                total += np.bincount(entropy_levels(data)[inside], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(at, pa.int64()), "n": pa.array(total[at])})

    return docs.select(text_col).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, and which windows lie within one text."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    if len(data) < WINDOW:
        return data, np.zeros(0, bool)
    inside = np.ones(len(data) - WINDOW + 1, bool)
    ends = np.cumsum([len(x) for x in rows])[:-1]
    for e in ends:
        inside[max(0, e - WINDOW + 1) : e] = False
    return data, inside


def rank_table(counts: list[tuple[int, int]]) -> np.ndarray:
    """Rank by level: 0 is the rarest; ties go to the lower level. Levels that never occur rank first."""
    n = np.zeros(LEVELS, np.int64)
    for level, k in counts:
        n[level] = k
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort([np.arange(LEVELS), n])] = np.arange(LEVELS)
    return ranks


def feature_starts(levels: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows with enough votes, or else of the best window."""
    n = len(levels)
    if not n:
        return np.zeros(0, np.int64)
    key = (ranks[levels] << 32) | np.arange(n)  # ties go to the left
    if n <= RUN:
        return np.array([int(key.min()) & 0xFFFFFFFF])
    size = -(-n // RUN) * RUN
    padded = np.full(size, np.iinfo(np.int64).max)
    padded[:n] = key
    grid = padded.reshape(-1, RUN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - RUN + 1], ahead[RUN - 1 : n])
    votes = np.bincount(best & 0xFFFFFFFF, minlength=n)
    chosen = np.flatnonzero(votes >= VOTES)
    return chosen if len(chosen) else np.array([int(votes.argmax())])


@dataclass(frozen=True)
class Digest:
    """Filters as rows of 256 bytes, and the number of features of each."""

    filters: np.ndarray
    counts: np.ndarray

    def spelled(self) -> str:
        """Features per filter, a colon, the filters in base 64."""
        return ".".join(map(str, self.counts.tolist())) + ":" + base64.b64encode(self.filters.tobytes()).decode()

    @staticmethod
    def read(text: str) -> Digest:
        counts, _, bits = text.partition(":")
        numbers = np.array([int(x) for x in counts.split(".") if x], np.int64)
        return Digest(np.frombuffer(base64.b64decode(bits), np.uint8).reshape(len(numbers), FILTER_BITS // 8), numbers)


def digest(text: bytes, ranks: np.ndarray) -> Digest:
    return digest_all([text], ranks)[0]


def digest_all(rows: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """A text of less than a window is one feature; the empty text has none and no filter."""
    out = []
    for a, b in slices(rows):
        joined = entropy_levels(np.frombuffer(b"".join(rows[a:b]), np.uint8)) if b - a > 1 else None
        at = 0
        for text in rows[a:b]:
            if len(text) < WINDOW:
                levels = np.zeros(0, np.int16)
            elif joined is None:
                levels = np.concatenate([x for _, _, x in windows_of(text)])
            else:
                levels = joined[at : at + len(text) - WINDOW + 1]
            at += len(text)
            out.append(_filled(text, levels, ranks))
    return out


def _filled(text: bytes, levels: np.ndarray, ranks: np.ndarray) -> Digest:
    if not text:
        return Digest(np.zeros((0, FILTER_BITS // 8), np.uint8), np.zeros(0, np.int64))
    if not len(levels):
        hashes = np.array([int.from_bytes(hashlib.sha256(text).digest()[:8], "little")], np.uint64)
    else:
        starts = feature_starts(levels, ranks)
        data = np.frombuffer(text, np.uint8)
        hashes = mixed((BYTES[data[starts[:, None] + np.arange(WINDOW)]] * POWERS).sum(axis=1, dtype=np.uint64))
        _, where = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(where)]
    which = np.arange(len(hashes)) // FEATURES
    bits = np.zeros((which[-1] + 1, FILTER_BITS), bool)
    for k in range(HASHES):
        bits[which, (hashes >> np.uint64(12 * k)).astype(np.int64) % FILTER_BITS] = True
    return Digest(np.packbits(bits, axis=1), np.bincount(which))


def likeness(a: Digest, b: Digest) -> float:
    """Mean over the filters of the shorter digest of the best match in the other; 0 to 1, and 1 for equal digests.

    Two empty digests are alike (1), an empty one and another are not (0).
    """
    if len(a.counts) > len(b.counts) or (len(a.counts) == len(b.counts) and a.spelled() > b.spelled()):
        a, b = b, a
    if not len(a.counts):
        return float(not len(b.counts))
    x = np.unpackbits(a.filters, axis=1).astype(np.float32)
    y = np.unpackbits(b.filters, axis=1).astype(np.float32)
    nx, ny = x.sum(axis=1, dtype=np.float64)[:, None], y.sum(axis=1, dtype=np.float64)[None, :]
    common, most, chance = (x @ y.T).astype(np.float64), np.minimum(nx, ny), nx * ny / FILTER_BITS
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)
    return float(np.mean(np.where(common == np.maximum(nx, ny), 1.0, score).max(axis=1)))


SORT_BYTES = 17
TOGETHER = 256  # rows
BUCKET_ROWS = 20_000


def _sort_keys(known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Fixed-width byte keys in the order of (NULL first, id, hash)."""
    out = np.empty((len(ids), SORT_BYTES), np.uint8)
    out[:, 0] = known.astype(np.uint8) + 1
    flip = np.uint64(1 << 63)
    out[:, 1:9] = (ids.astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (hashes.astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{SORT_BYTES}").ravel()


def digests(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id`` and ``fingerprint``. NULL texts are empty; repeated rows get equal digests; an empty table gives none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.spelled() for x in digest_all(texts(batch.column(1)), ranks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, fingerprint string")


def pairs_with_next(docs: DataFrame) -> DataFrame:
    """Rows (_bucket, _extra, _id, _hash, _text) such that each bucket holds a stretch of the order by (doc_id, hash of the text)
    and, marked extra, the row that follows it (after the last the first).

    The buckets' first keys come from a pass over the narrow keys; the texts are shuffled once. NULL ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    # a number of its own, as the keys are narrow and would be merged into a few partitions
    stretches = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET_ROWS + 1)
    keys = rows.select("_id", "_hash").repartitionByRange(stretches, F.col("_id").asc_nulls_first(), "_hash")
    place = F.struct(F.col("_id").isNotNull().alias("known"), F.coalesce("_id", F.lit(0).cast("long")).alias("id"), F.col("_hash").alias("hash"))
    # one row per stretch
    heads = sorted(tuple(r["head"]) for r in keys.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(place).alias("head")).collect())
    n = max(1, len(heads))
    columns = [np.array(x) for x in zip(*heads)] if heads else [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    edges = _sort_keys(*columns)

    @F.pandas_udf("long")
    def bucket_of(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the bucket, and one more for the bucket's first key."""
        own = _sort_keys(known.to_numpy(), ids.to_numpy(), hashes.to_numpy())
        at = np.searchsorted(edges, own, side="right") - 1
        return pd.Series(2 * at + (edges[at] == own))

    code = bucket_of(F.col("_id").isNotNull(), F.coalesce("_id", F.lit(0).cast("long")), "_hash")
    coded = rows.withColumn("_code", code)
    bucket = F.shiftright("_code", 1)
    before = F.pmod(bucket - 1, F.lit(n))
    head = F.col("_code").bitwiseAND(F.lit(1)) == 1
    own = F.struct(bucket.alias("b"), F.lit(0).alias("x"))
    placed = coded.withColumn("_to", F.explode(F.when(head, F.array(own, F.struct(before.alias("b"), F.lit(1).alias("x")))).otherwise(F.array(own))))
    out = placed.select(F.col("_to.b").alias("_bucket"), F.col("_to.x").alias("_extra"), "_id", "_hash", "_text")
    return out.repartitionByRange(n, "_bucket").sortWithinPartitions("_bucket", "_extra", F.col("_id").asc_nulls_first(), "_hash")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Each document's digest, that of its edited text, and the likeness of its digest to that and to the next document's.

    The order is by doc_id, NULL first, and among equal ids by a hash of the text; repeated rows follow one another. NULL texts
    are empty. A single row is its own next. An empty table gives an empty result. Other columns are not read.
    """
    rows = pairs_with_next(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next one
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.slice(at, TOGETHER)
                buckets, extras, ids = (batch.column(c).to_pylist() for c in ("_bucket", "_extra", "_id"))
                rows = [x or "" for x in batch.column("_text").to_pylist()]
                pairs = []
                for row in zip(buckets, extras, ids, rows, digest_all([x.encode() for x in rows], ranks)):
                    if held is not None and held[0] == row[0]:
                        pairs.append((held, row))
                    # the last row of a bucket is followed by an extra one; any further extra rows are copies of that
                    held = None if row[1] else row
                if pairs:
                    changed = [edited(was[3], row[3]).encode() for was, row in pairs]
                    others = digest_all(changed, ranks)
                    yield _batch([(was[2], len(was[3]), hashlib.sha256(text).hexdigest(), was[4].spelled(), other.spelled(),
                                   likeness(was[4], other), likeness(was[4], row[4])) for (was, row), text, other in zip(pairs, changed, others)])

    return rows.mapInArrow(work, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
