"""Web archives as seekable Zstandard bundles.

A bundle is a complete ``.warc.zst`` file: records are grouped into frames that decompress on their
own, and a footer, a skippable frame, holds the seek table with the sizes of all frames. Beside it
goes the index of its records: identifier, frame, and offset within the decompressed frame, so that
one record is read by decompressing one frame. Bundles are rows of a table that Spark writes and
commits, so a task that is repeated leaves nothing behind and any store that Spark knows will do;
``save_files`` and ``read_files`` turn them into files and back.

Of records with equal payloads of ``min_bytes`` and more, the one with the largest identifier is a
response and the others revisit it. Payloads count as equal when length and SHA-256 are.

Defined results: a null payload is empty; a null identifier is written as ``null`` and is never the
largest unless its whole group is null, when all are responses; rows that repeat the largest
identifier are all responses; a null URL is left out of the record. Only the three named columns are
read. An empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from functools import partial
from pathlib import PurePosixPath

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut

#: Fixed values of the seekable format: the footer's skippable frame, its last four bytes, bytes before them.
SKIPPABLE, SEEKABLE, TAIL = 0x184D2A5E, 0x8F92EAB1, 9
#: Fixed value: what a revisit record of equal payload says of itself.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BUNDLES = "bundle string, content binary, records array<struct<record: string, frame: int, offset: int>>"
RECORDS = "bundle string, frame int, offset int, id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(own: object, url: str | None, payload: bytes, winner: object | None) -> bytes:
    """One WARC record; a revisit of ``winner``, if there is one, holds no payload but its length and digest."""
    name = "null" if own is None else str(own)
    head = ["WARC/1.1", f"WARC-Type: {'response' if winner is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if winner is not None:
        head += [f"WARC-Refers-To: <urn:page:{winner}>", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset of a decompressed frame, and where the next begins."""
    end = frame.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    return head, frame[end + 4 : end + 4 + size], end + 8 + size


def bundle(frames: list[bytes], level: int = 3) -> bytes:
    """Frames compressed one by one, and the seek table."""
    zipped = [zstandard.ZstdCompressor(level=level).compress(f) for f in frames]
    table = b"".join(struct.pack("<II", len(z), len(f)) for z, f in zip(zipped, frames, strict=True))
    table += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(zipped) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-TAIL:])
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    entry = 12 if flags & 128 else 8
    begin = len(content) - TAIL - n * entry
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", content, begin + k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def frame(content: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def read_record(content: bytes, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """A record by its place in the index; one frame is decompressed."""
    return parse(frame(content, seek_table(content)[number]), offset)[:2]


def _write(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    frames: list[bytearray] = []
    records: list[dict] = []
    held = 0

    def full() -> pa.RecordBatch:
        content = bundle([bytes(f) for f in frames])
        kinds = pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{made:06d}"]), pa.array([content], pa.binary()), pa.array([records], kinds)], ["bundle", "content", "records"])

    for batch in batches:
        for own, url, html, winner in zip(*(batch.column(c) for c in ("id", "url", "html", "winner")), strict=True):
            made_record = record(own.as_py(), url.as_py(), (html.as_py() or "").encode(), winner.as_py())
            if not frames or len(frames[-1]) >= frame_bytes:
                frames.append(bytearray())
            records.append({"record": "null" if own.as_py() is None else str(own.as_py()), "frame": len(frames) - 1, "offset": len(frames[-1])})
            frames[-1] += made_record
            held += len(made_record)
            if held >= bundle_bytes:
                yield full()
                made, held, frames, records = made + 1, 0, [], []
    if frames:
        yield full()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    bare = lambda uri: uri and uri.removeprefix("<urn:page:").removesuffix(">")
    for batch in batches:
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
            content = content.as_py()
            for number, entry in enumerate(seek_table(content)):
                plain, at, rows = frame(content, entry), 0, []
                while at < len(plain):
                    head, payload, following = parse(plain, at)
                    revisit = head["WARC-Type"] == "revisit"
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"]) if revisit else len(payload)
                    rows.append((name, number, at, bare(head["WARC-Record-ID"]), head["WARC-Type"], head.get("WARC-Target-URI"), None if revisit else payload, size, said, bare(head.get("WARC-Refers-To")), revisit or digest(payload) == said))
                    at = following
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_bundles(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 23
) -> DataFrame:
    """Archive all rows: a table of (bundle, content, records), written to the shared folder.

    ``frame_bytes`` and ``bundle_bytes`` are of plain records; a larger record has a frame of its own.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html"))
    shared = own.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    told = own.join(cut(shared.drop("n"), "payloads"), ["digest", "size"], "left")
    told = told.withColumn("winner", F.when(~F.col("id").eqNullSafe(F.col("winner")), F.col("winner")))
    rows = told.select("id", "url", "html", "winner").mapInArrow(partial(_write, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes), BUNDLES)
    return cut(rows, "bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """(record, bundle, frame, offset) of each record, without reading the bundles' contents."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record", "bundle", "r.frame", "r.offset")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame; ``intact`` says that a payload has the digest its record names."""
    return bundles.select("bundle", "content").mapInArrow(_read, RECORDS)


def _save(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("bundle").to_pylist()
        for name, content in zip(names, batch.column("content"), strict=True):
            path = os.path.join(folder, f"{name}.warc.zst")
            part = f"{path}.{TaskContext.get().taskAttemptId()}"
            with open(part, "wb") as f:
                f.write(content.as_py())
            os.replace(part, path)
        yield pa.RecordBatch.from_arrays([batch.column("bundle")], ["bundle"])


def save_files(bundles: DataFrame, folder: str) -> int:
    """Write each bundle as a file of a folder that all executors share; the number of files."""
    return bundles.select("bundle", "content").mapInArrow(partial(_save, folder=folder), "bundle string").count()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the ``.warc.zst`` files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    name = F.udf(lambda p: PurePosixPath(p).name.removesuffix(".warc.zst"), "string")
    return read_bundles(files.select(name("path").alias("bundle"), "content"))
