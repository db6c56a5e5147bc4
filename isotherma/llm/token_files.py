"""Token ids in binary shards with Elias-Fano coded document boundaries.

Documents are range-partitioned by id; each partition is a shard of two files:

* ``*.ids``: the ids of its documents one after another, each document closed by an end id, little-endian unsigned of 2 bytes
  (4 if the vocabulary needs it);
* ``*.ef``: number of NULL ids, width of an id, length of the first part (8 bytes each); then the boundaries (one more than there are
  documents) and the document ids that aren't NULL, both Elias-Fano coded.

Tasks name files by their attempt and report them in the manifest, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from . import elias_fano
from .store import HELD, opened

HEAD = "<QQQ"
CACHED = 600_000  # chunks in each of two generations, and half as many pieces, whose ids a worker keeps
LONGEST = 48  # characters of a chunk that is kept
BEYOND = "\u0250"  # letters below are classed alike by all libraries
SPACE_LETTER = "\u0120"  # by which byte-level vocabularies spell a space
END = 0
WRITE_BYTES = 1 << 22  # written at once
MANIFEST = "part long, name string, docs long, ids long"
ROWS = 4_000


class Kept:
    """Two generations of what was computed: the older one goes when the younger is full, but for what was used meanwhile."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def add(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ChunkEncoder:
    """The tokenizer's ids as bytes.

    Byte-level BPE merges within the pieces of its splitting pattern only. So a text may be cut before each single space that stands
    between two characters that aren't white space, and a chunk into those pieces, without changing the ids; ids of short chunks and
    pieces are kept. Texts with special tokens and chunks beyond Latin letters go to the tokenizer as they are.
    """

    single_space = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.splits = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.width == "H" else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_letter = byte_letters()
        self.chunks, self.parts = Kept(CACHED), Kept(CACHED // 2)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        found = self.parts.old.get(text)
        if found is None:
            spelled = text.encode().decode("latin-1").translate(self.byte_letter)
            found = array(self.width, [x.id for x in self.model.tokenize(spelled)]).tobytes()
        self.parts.add(text, found)
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of a space and the chunk."""
        found = self.chunks.old.get(text)
        if found is None:
            if len(text) > LONGEST or not text:
                return self.plain(" " + text)
            if text.isascii() and text.isalpha():  # one piece, spelled as it is
                found = array(self.width, [x.id for x in self.model.tokenize(SPACE_LETTER + text)]).tobytes()
            elif max(text) >= BEYOND:
                return self.plain(" " + text)
            else:
                young = self.parts.young
                if text[-1] in ",." and text[:-1].isalpha():  # a word and the mark behind it
                    pieces = (" " + text[:-1], text[-1])
                else:
                    pieces = (" " + text,) if text.isalpha() else self.pieces.findall(" " + text)
                found = b"".join([young.get(x) or self.piece(x) for x in pieces])
        self.chunks.add(text, found)
        return found

    def encode(self, text: str) -> bytes:
        if not self.splits or any(x in text for x in self.special):
            return self.plain(text)
        chunks = text.split(" ")
        if "" in chunks or len(text.split()) != len(chunks) + text.count("\n"):  # white space next to white space, or of another kind
            chunks = self.single_space.split(text)
        head = self.plain(chunks[0]) if chunks[0] else b""
        del chunks[0]
        found = list(map(self.chunks.young.get, chunks))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.chunk(chunks[at])
        return head + b"".join(found)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}


def encoder(path: str) -> ChunkEncoder:
    if path not in HELD:
        HELD[path] = ChunkEncoder(path)
    return HELD[path]


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to ``folder`` in ascending order of id and return the manifest, which is stored there too.

    NULL texts are empty and have the end id alone. NULL ids come first. Repeated ids are documents of their own, in the order of
    a hash of their texts, and a hot id may span shards. An empty table gives an empty manifest. Other columns are not read.
    """
    texthash = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), texthash.alias("_hash"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first(), "_hash").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, codec = TaskContext.get(), encoder(tokenizer_path)
        end = np.array([END], codec.dtype).tobytes()
        store, path = opened(folder)
        name, ids, bounds, nulls = f"{task.partitionId():06d}-{task.taskAttemptId()}", [], [0], 0
        out, waiting, size = None, [], 0
        for batch in batches:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.ids", compression=None)
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                data = codec.encode(text.as_py() or "") + end
                waiting.append(data)
                size += len(data)
                if size >= WRITE_BYTES:
                    out.write(b"".join(waiting))
                    waiting, size = [], 0
                bounds.append(bounds[-1] + len(data) // codec.dtype.itemsize)
                if doc is None:
                    nulls += 1
                else:
                    ids.append(doc)
        if out is None:
            return
        out.write(b"".join(waiting))
        out.close()
        first = elias_fano.encode(np.array(bounds, np.int64))
        with store.open_output_stream(f"{path}/{name}.ef", compression=None) as f:
            f.write(struct.pack(HEAD, nulls, codec.dtype.itemsize, len(first)) + first + elias_fano.encode(np.array(ids, np.int64)))
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(bounds) - 1], "ids": [bounds[-1]]})

    manifest = stored(ordered.select("_id", "_text").mapInArrow(write, MANIFEST), "token-manifest")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


class Shard:
    """A shard opened for random access: nothing but the boundaries is held."""

    def __init__(self, folder: str, name: str) -> None:
        store, path = opened(folder)
        with store.open_input_file(f"{path}/{name}.ef") as f:
            data = f.read()
        self.nulls, width, size = struct.unpack_from(HEAD, data)
        self.dtype = np.dtype(f"<u{width}")
        self.bounds = elias_fano.Sequence(data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + size])
        self.doc_ids = elias_fano.Sequence(data[struct.calcsize(HEAD) + size :])
        self.file = store.open_input_file(f"{path}/{name}.ids")

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def ids_between(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.dtype.itemsize, begin * self.dtype.itemsize), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the shard."""
        begin, end = self.bounds.range(i, i + 2)
        return self.ids_between(int(begin), int(end))

    def ids_of_rows(self, begin: int, end: int) -> list[int | None]:
        """Document ids of the shard's documents ``begin`` to ``end``."""
        split = min(max(self.nulls, begin), end)
        return [None] * (split - begin) + self.doc_ids.range(split - self.nulls, end - self.nulls).tolist()


def read_documents(spark: SparkSession, folder: str, schema_extra: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32.

    ``schema_extra`` adds the ids themselves as an array.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if schema_extra else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                for at in range(0, len(shard), ROWS):
                    stop = min(len(shard), at + ROWS)
                    bounds = shard.bounds.range(at, stop + 1)
                    found = [shard.ids_between(int(a), int(b)) for a, b in zip(bounds, bounds[1:])]
                    out = {"doc_id": pa.array(shard.ids_of_rows(at, stop), pa.int64()), "start": pa.array(bounds[:-1] + base),
                           "n_tokens": pa.array(np.diff(bounds)),
                           "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())}
                    if schema_extra:
                        out["ids"] = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return shards.select("name", "base").repartition(n).mapInArrow(read, schema)
