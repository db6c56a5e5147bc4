"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records, closed by a skippable frame with a seek table
(compressed and raw size of every frame). The index maps a record id to bundle, frame and offset within the raw frame, so one
record costs one frame. Payloads that occur more than once are stored once; the other records revisit that one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .store import opened

# Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

FRAME_BYTES = 1 << 20
DEDUP_BYTES = 1000
ROWS = 2_000
FRAMES_A_TASK = 16  # of about FRAME_BYTES each
INDEX = "record_id string, page_id long, name string, frame long, offset long, length long"


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}").urn


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """Id and bytes of a record. Revisits have the HTTP head alone."""
    name = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to, digest)}>", "X-Refers-To-Page": str(refers_to)}
    head["Content-Length"] = str(len(block))
    return name, "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in head.items()], "\r\n"]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Head and block of the record at ``at``, and where the next begins."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    return head, raw[begin:stop], stop + 4


class BundleWriter:
    def __init__(self, out) -> None:
        self.out, self.zstd, self.raw, self.sizes = out, zstandard.ZstdCompressor(level=3), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.raw and len(self.raw) + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.sizes), len(self.raw)
        self.raw += data
        return at

    def flush(self) -> None:
        if self.raw:
            packed = self.zstd.compress(bytes(self.raw))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.raw)))
            self.raw.clear()

    def close(self) -> None:
        self.flush()
        table = np.array(self.sizes, "<u4").tobytes() + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Bundle:
    """A bundle opened for random access by frame."""

    def __init__(self, folder: str, name: str) -> None:
        store, path = opened(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        self.sizes = np.frombuffer(self.file.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.sizes[k, 0]), int(self.begins[k]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k, 1]))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to ``folder`` and return the index, which is stored there too.

    Of equal payloads of at least 1000 bytes, the row with the largest page_id is a response and the others revisit it; rows that
    repeat that page_id with the same payload are responses as well, under one record id. NULL html is empty, NULL url is left out. A NULL
    page_id ranks below all others and revisits them; if all are NULL, all are responses. An empty table gives an empty index. Other columns
    are not read. Bundles are named by the task's attempt; only those in the index count.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("_shared", F.when(F.octet_length("payload") >= DEDUP_BYTES, F.col("digest")))
    kept = rows.where(F.col("_shared").isNotNull()).groupBy("_shared").agg(F.max("page_id").alias("kept"), F.count("*").alias("_n")).where("_n > 1")
    found = rows.join(kept.drop("_n"), "_shared", "left").withColumn("revisit", F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = opened(folder)
        name, out = f"{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst", None
        for batch in batches:
            if out is None:
                store.create_dir(path, recursive=True)
                out = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None))
            rows = []
            for page_id, url, payload, digest, kept, revisit in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "kept", "revisit")]):
                key, data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), kept.as_py(), revisit.as_py())
                rows.append((key, page_id.as_py(), name, *out.add(data), len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) if k not in (1,) else pa.array(x, pa.int64()) for k, x in enumerate(zip(*rows))],
                                                 names=["record_id", "page_id", "name", "frame", "offset", "length"])
        if out is not None:
            out.close()

    index = stored(found.select("page_id", "url", "payload", "digest", "kept", "revisit").mapInArrow(write, INDEX), "warc-index")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return index


def read_record(folder: str, name: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; reads one frame."""
    head, block, _ = parsed(Bundle(folder, name).frame(frame), offset)
    return head, block


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames spread over as many tasks as they need at ``FRAMES_A_TASK``; neighbours in a bundle stay together, so each is opened in few tasks."""
    return frames.repartitionByRange(max(1, -(-frames.count() // FRAMES_A_TASK)), "name", "frame")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, from the bundles: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A response's size and digest are computed from its payload and must agree with its head; a revisit's stand in its head.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    frames = _dealt(index.select("name", "frame").distinct())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, Bundle] | None = None
        for batch in batches:
            for name, frame in zip(batch.column("name").to_pylist(), batch.column("frame").to_pylist()):
                if last is None or last[0] != name:
                    last = name, Bundle(folder, name)
                raw, at, rows = last[1].frame(frame), 0, []
                while at < len(raw):
                    head, block, at = parsed(raw, at)
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']} in {name}")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                for k in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + ROWS]), kinds)],
                                                     names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(read, schema)
