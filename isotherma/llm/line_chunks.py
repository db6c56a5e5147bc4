"""Line dedup by content-defined chunks of lines, and by passages of lines.

A chunk ends after a line if the rolling hash of that line's and the previous line's hashes is less than those of the lines beside it; so
an insertion moves boundaries only near itself, a shared passage is cut alike wherever it stands, and no chunk but that of a text of one line has
less than two. Chunks that occur more than once in the whole table are removed but for their first occurrence, after their bytes have been compared.

A passage may hold no whole chunk, and its edges seldom do. So runs of lines from each line, and up to each line, that just reach a number of words
are looked up too. What they hold depends on the passage alone, and they cover all of a passage of that many words: with i..j such a passage, a line of it
is in the run from i or in the run up to itself. They overlap, so the SHA-256 of their bytes is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .store import texts

LONGEST = 64  # lines, one more at the end of a text
LEAST = 2  # lines of a chunk or passage
PASSAGE_WORDS = 50  # of a passage that is removed up to its edges
WORD_BYTES = 12  # of a word at most, so that scripts without spaces have words
MASK = (1 << 64) - 1


def cut(text: bytes, longest: int = LONGEST) -> list[list[bytes]]:
    """The text's lines as chunks; joining all lines by newlines gives the text back."""
    lines = text.split(b"\n")
    rolled, before = [], 0
    for line in lines:
        own = xxhash.xxh3_64_intdigest(line)
        mix = (before * 0x9E3779B97F4A7C15 + own) & MASK
        rolled.append(mix ^ (mix >> 29))
        before = own
    out, begin = [], 0
    for i in range(LEAST - 1, len(lines) - LEAST):
        size = i + 1 - begin
        if size >= longest or size >= LEAST and rolled[i - 1] > rolled[i] < rolled[i + 1]:
            out.append(lines[begin:i + 1])
            begin = i + 1
    return [*out, lines[begin:]]


def passages(lines: list[bytes], least: int) -> set[tuple[int, int]]:
    """(begin, end) of the shortest runs of at least two lines and ``least`` words from each line and up to each line."""
    total = [0, *accumulate(max(len(x.split()), len(x) // WORD_BYTES) for x in lines)]
    out, end, begin = set(), 0, 0
    for i in range(len(lines) - LEAST + 1):
        end = max(end, i + LEAST)
        while end <= len(lines) and total[end] - total[i] < least:
            end += 1
        if end > len(lines):
            break
        out.add((i, end))
    for j in range(LEAST, len(lines) + 1):
        while begin < j - LEAST and total[j] - total[begin + 1] >= least:
            begin += 1
        if total[j] - total[begin] >= least:
            out.add((begin, j))
    return out


def runs(text: bytes, least: int | None) -> tuple[list[bytes], list[tuple[int, int, bool]]]:
    """The lines, and by place (begin, end, whether a passage) of what may be removed: chunks and, unless ``least`` is None, passages."""
    out, begin = [], 0
    for chunk in cut(text):
        if len(chunk) >= LEAST:
            out.append((begin, begin + len(chunk), False))
        begin += len(chunk)
    lines = text.split(b"\n")
    if least is not None:
        out = sorted([*out, *((a, b, True) for a, b in passages(lines, least))])
    return lines, out


def _order(id_col: str) -> list[Column]:
    return [F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), F.col("_hash"), F.col("_no")]


def _chunks(rows: DataFrame, with_bytes: bool, least: int | None) -> DataFrame:
    """(_id, _hash, _no, _key[, _bytes]) of each run that may be removed; with bytes, or the SHA-256 of a passage, of those numbers that ``_nos`` names."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("_nos").to_pylist() if with_bytes else [None] * len(batch)
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = []
                for doc, digest, text, nos in zip(part.column("_id").to_pylist(), part.column("_hash").to_pylist(), texts(part.column("_text")), wanted[at:]):
                    some = None if nos is None else set(nos)
                    lines, found = runs(text, least)
                    for no, (begin, end, passage) in enumerate(found):
                        if some is None or no in some:
                            whole = b"\n".join(lines[begin:end])
                            key = xxhash.xxh3_128_digest(whole, int(passage))
                            out.append((doc, digest, no, key, (hashlib.sha256(whole).digest() if passage else whole) if with_bytes else None))
                if out:
                    cols = list(zip(*out))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    names = ["_id", "_hash", "_no", "_key", "_bytes"]
                    n = 5 if with_bytes else 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names=names[:n])

    return rows.mapInArrow(chunk, "_id long, _hash long, _no int, _key binary" + (", _bytes binary" if with_bytes else ""))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int | None = None) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines and n_removed (lines).

    Chunks that repeat are removed; with ``least`` also each line of passages of two or more lines and ``least`` or more words that stand
    further ahead too. Lines of a first occurrence that a later one in the same text overlaps stay. Of each line removed a copy stays further ahead.

    The first occurrence, which stays, is that with the smallest id (NULL last), then smallest hash of the text, then first in the
    text. Rows that repeat both id and text are one document and are treated alike. NULL texts stay NULL and have no lines; an
    empty text is one empty line. A text of which all is removed becomes empty. An empty table gives an empty result. Columns of
    ``docs`` named n_lines or n_removed are replaced.
    """
    texthash = F.xxhash64(text_col)
    kept = docs.drop("n_lines", "n_removed")
    rows = kept.select(F.col(id_col).alias("_id"), texthash.alias("_hash"), F.col(text_col).alias("_text"))
    chunks = stored(_chunks(rows, False, least), "line-chunks")
    often = chunks.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    same_doc = ["_null", "_known", "_hash"]
    keyed = lambda df: df.withColumn("_null", F.col("_id").isNull()).withColumn("_known", F.coalesce("_id", F.lit(0).cast("long")))
    wanted = keyed(chunks.join(often, "_key")).groupBy(*same_doc).agg(F.collect_set("_no").alias("_nos"))
    suspects = keyed(rows).join(wanted, same_doc).select("_id", "_hash", "_text", "_nos")
    found = keyed(stored(_chunks(suspects, True, least), "line-suspects"))
    place = F.struct("_null", "_known", "_hash", "_no")
    # grouping by the bytes themselves is the comparison
    first = found.groupBy("_key", "_bytes").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = found.join(first, ["_key", "_bytes"]).where(place != F.col("_first"))
    own = F.when(F.struct(*same_doc) == F.struct(*[F.col(f"_first.{c}").alias(c) for c in same_doc]), F.col("_first._no")).otherwise(-1)
    gone = later.groupBy(*same_doc).agg(F.collect_set(F.struct("_no", own.alias("_own"))).alias("_gone"))
    wide = kept.withColumn("_null", F.col(id_col).isNull()).withColumn("_known", F.coalesce(F.col(id_col), F.lit(0).cast("long"))).withColumn("_hash", texthash)
    joined = wide.join(gone, same_doc, "left").drop(*same_doc)
    n_lines = F.when(F.col(text_col).isNotNull(), F.size(F.split(text_col, "\n", -1))).otherwise(0).cast("long")
    schema = joined.drop("_gone").withColumn("n_lines", n_lines).withColumn("n_removed", n_lines).schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                column, gone = batch.column(text_col), batch.column("_gone").to_pylist()
                clean, lines, removed = [], [], []
                for text, null, nos in zip(texts(column), column.is_null().to_pylist(), gone):
                    lines.append(0 if null else text.count(b"\n") + 1)
                    drop = bytearray(lines[-1])
                    if nos:
                        parts, found = runs(text, least)
                        for x in nos:
                            begin, end, _ = found[x["_no"]]
                            begin = begin if x["_own"] < 0 else max(begin, found[x["_own"]][1])
                            drop[begin:end] = b"\1" * (end - begin)
                        text = b"\n".join(part for part, out in zip(parts, drop) if not out)
                    clean.append(None if null else text)
                    removed.append(sum(drop))
                arrays = {f.name: batch.column(f.name) for f in batch.schema if f.name != "_gone"}
                arrays[text_col] = pa.array(clean, pa.binary()).cast(column.type)
                yield pa.RecordBatch.from_pydict(arrays | {"n_lines": pa.array(lines, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    return joined.mapInArrow(rebuild, schema)
