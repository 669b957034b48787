"""Raw capture segments: append-only files of checksummed records.

A segment is a header and records; a record that fails its length or checksum ends the
valid part of its file (a torn tail).  Files are read whole through Spark's binary source,
so any file system will do; writers rotate them, which bounds a file's size."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The segment format.  Header: magic, version, venue, reserved, start wall and
# monotonic clocks, length of the notes; record: length, kind, two clocks, payload, checksum.
MAGIC = b"FBRAW001"
HEADER = struct.Struct("<8sBBHQQI")
RECORD = struct.Struct("<IBQQ")
WS_TEXT, WS_BINARY, REST_SNAPSHOT, NOTE = 1, 2, 3, 4
MAX_PAYLOAD = 64 * 1024 * 1024

_RECORDS = "path string, venue int, seq bigint, rkind int, recv_mono bigint, recv_wall bigint, payload binary"
_REPORT = "path string, venue int, records bigint, payload_bytes bigint, header_bytes bigint, valid_bytes bigint, torn string"
_MANIFEST = "path string, venue int, records bigint, bytes bigint"


def encode(venue: int, records: list[tuple[int, int, int, bytes]], notes: bytes = b"{}") -> bytes:
    """A segment of records (kind, monotonic, wall, payload)."""
    first = records[0] if records else (0, 0, 0, b"")
    out = [HEADER.pack(MAGIC, 1, venue, 0, first[2], first[1], len(notes)), notes]
    for kind, mono, wall, payload in records:
        body = RECORD.pack(0, kind, mono, wall)[4:] + payload
        out += [struct.pack("<I", len(body) + 4), body, struct.pack("<I", zlib.crc32(body))]
    return b"".join(out)


def decode(data: bytes) -> tuple[int, list[tuple[int, int, int, bytes]], int, str | None]:
    """Venue, records, valid bytes, and why the tail is torn (None if the file ends cleanly)."""
    if len(data) < HEADER.size:
        return 0, [], 0, "short header"
    magic, version, venue, _, _, _, notes = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        return 0, [], 0, "not a segment"
    at, records = HEADER.size + notes, []
    while at < len(data):
        if at + 4 > len(data):
            return venue, records, at, "short length"
        (size,) = struct.unpack_from("<I", data, at)
        if not 21 <= size <= MAX_PAYLOAD + 21:
            return venue, records, at, "bad length"
        if at + 4 + size > len(data):
            return venue, records, at, "short record"
        body = data[at + 4 : at + size]
        if zlib.crc32(body) != int.from_bytes(data[at + size : at + size + 4], "little"):
            return venue, records, at, "bad checksum"
        _, kind, mono, wall = RECORD.unpack_from(data, at)
        records.append((kind, mono, wall, body[17:]))
        at += 4 + size
    return venue, records, at, None


def _plain(path: str, data: bytes) -> bytes:
    if not path.endswith(".zst"):
        return data
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def records(files: DataFrame) -> DataFrame:
    """Valid records of segment files (path, content), in file order by ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                venue, found, _, _ = decode(_plain(path, content))
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    columns = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([venue] * len(part), pa.int32()), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())],
                        names=["path", "venue", "seq", "rkind", "recv_mono", "recv_wall", "payload"],
                    )

    return files.select("path", "content").mapInArrow(run, _RECORDS)


def report(files: DataFrame) -> DataFrame:
    """One row for each segment file: records, bytes of payloads, header and all that is
    valid, and why the tail is torn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                venue, found, valid, torn = decode(_plain(path, content))
                sizes = [25 + len(r[3]) for r in found]
                out.append((path, venue, len(found), sum(sizes) - 25 * len(sizes), valid - sum(sizes), valid, torn))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in _REPORT.split(", ")])

    return files.select("path", "content").mapInArrow(run, _REPORT)


def recover(files: DataFrame) -> DataFrame:
    """Segment files (path, content) cut to their valid part; a file without a valid header
    becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _plain(path, content)
                kept.append(data[: decode(data)[2]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


class Roller:
    """Records of one venue in order to segment images of at most ``most`` bytes."""

    def __init__(self, most: int):
        self.most, self.venue, self.size = most, 0, 0
        self.held: list[tuple[int, int, int, bytes]] = []
        self.first = 0

    def add(self, venue: int, event: int, record: tuple[int, int, int, bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
        if self.held and (venue != self.venue or self.size + 25 + len(record[3]) > self.most):
            yield from self.close()
        if not self.held:
            self.venue, self.first = venue, event
        self.held.append(record)
        self.size += 25 + len(record[3])

    def close(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(venue, wall clock and event of the first record, records, image)"""
        if self.held:
            yield self.venue, self.held[0][2], self.first, len(self.held), encode(self.venue, self.held)
        self.held, self.size = [], 0


def write(frames: DataFrame, root: str, most: int = 64 << 20) -> None:
    """Write frames (venue, event_id, sub, recv_mono, recv_wall, payload) as segment files of
    at most ``most`` bytes below ``root``, a folder that all executors reach by its URI.

    Files are named by their first record and moved into place whole.  A manifest that Spark
    commits lists those that count, so what a lost task leaves behind is never read."""
    order = ["venue", "recv_mono", "event_id", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        roller = Roller(most)

        def put(images_: Iterator[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for venue, wall, event, n, data in images_:
                name = f"{venue}/{venue}-{wall}-{event}-{zlib.crc32(data):08x}.fbraw"
                system.create_dir(f"{base}/{venue}")
                written, half = f"{base}/{name}", f"{base}/{venue}/.{uuid.uuid4().hex}"
                with system.open_output_stream(half) as out:
                    out.write(data)
                system.move(half, written)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((written, venue, n, len(data)), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "venue", "records", "bytes"])

        for batch in batches:
            for venue, event, mono, wall, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                yield from put(roller.add(venue, event, (WS_TEXT, mono, wall, payload)))
        yield from put(roller.close())

    dealt = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("venue", "event_id", "recv_mono", "recv_wall", F.col("payload").cast("binary").alias("payload"))
    dealt.mapInArrow(run, _MANIFEST).write.mode("errorifexists").parquet(f"{root}/_manifest")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files that the manifest of ``root`` lists."""
    name = lambda c: F.substring_index(c, "/", -1)
    listed = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest").select(name("path").alias("_name"))
    return read_files(spark, root).withColumn("_name", name("path")).join(listed, "_name", "left_semi").drop("_name")


def images(frames: DataFrame, cell: str) -> DataFrame:
    """Segment images (path, content) of frames (venue, event_id, sub, recv_mono, recv_wall,
    payload, ...), one for each venue and ``cell``, with the cell's column.  Rows come in
    sorted partitions, so one segment is held at a time."""
    order = ["venue", cell, "recv_mono", "event_id", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def image() -> pa.RecordBatch:
            columns = [pa.array([f"{key[0]}/{key[1]}"]), pa.array([key[1]], pa.int64()), pa.array([encode(key[0], held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["path", cell, "content"])

        for batch in batches:
            for venue, own, mono, wall, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (venue, own) != key and key is not None:
                    yield image()
                    held = []
                key = (venue, own)
                held.append((WS_TEXT, mono, wall, payload))
        if key is not None:
            yield image()

    dealt = frames.repartition("venue", cell).sortWithinPartitions(*order).select("venue", F.col(cell).cast("bigint").alias(cell), "recv_mono", "recv_wall", F.col("payload").cast("binary").alias("payload"))
    return dealt.mapInArrow(run, f"path string, {cell} bigint, content binary")
