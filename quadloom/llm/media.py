"""Media columns: payloads in archives, read through a data source of our own.

Each payload is stored as the samples of an 8-bit gray PNG picture, a member of a
tar archive. The data source plans byte ranges over all archives of a folder; a
range yields the members whose header starts in it, as Arrow batches. A member that
fails its checksum is read again by offset, on a new handle, without touching its
neighbours; one that keeps failing becomes a row with an error and no media. After
a damaged header the reader looks for the next valid one. A range finds its first
header in the index of offsets that the writer leaves beside each archive; in an
archive without one it hops there from the archive's head.

Null and empty texts give one row of filling; equal texts give equal media. Rows are
stored one by one, so repeated rows and null ids keep their places; an empty table
leaves an empty folder, which reads as no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.llm._arrow import slices, texts_of
from quadloom.llm._shared import open_fs, put, work_dir, write_file

#: Samples in a row of the picture, and the payload's unit.
UNIT = 576
#: Byte of the filling, which no UTF-8 text has.
FILL = b"\xff"
BLOCK = tarfile.BLOCKSIZE
#: Size at which a task starts its next archive.
ARCHIVE = 256 << 20
#: Size of a planned byte range.
RANGE = 32 << 20
TRIES = 3
#: Ending of an archive's index: the offsets of its headers, ascending.
INDEX = ".idx"
#: Members' bytes in an Arrow batch of the source.
BATCH = 4 << 20

PNG = b"\x89PNG\r\n\x1a\n"


# pictures


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: bytes) -> bytes:
    """The text filled up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, FILL)


def to_png(payload: bytes) -> bytes:
    """Rows of UNIT gray samples, none of them filtered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of a picture that to_png wrote; ValueError if it is damaged."""
    at, data, size = len(PNG), [], None
    if media[:at] != PNG:
        raise ValueError("no picture")
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].ravel()


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and eight-step histogram of the samples, in whole thousandths and counts."""
    n, x = len(samples), samples.astype(np.int64)
    mean = int(x.sum()) * 1000 // n
    spread = int(np.sqrt(float((x * x).sum()) / n - (x.sum() / n) ** 2) * 1000)
    return f"mean={mean};dev={spread};hist={','.join(map(str, np.bincount(samples >> 5, minlength=8).tolist()))}"


# archives


def header(name: str, media: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.uname = len(media), f"crc32-{zlib.crc32(media):08x}"
    return info.tobuf(tarfile.USTAR_FORMAT)


def write_archives(rows: DataFrame, uri: str) -> DataFrame:
    """rows: id, text. Each task writes its archives; a row (archive, members, bytes) for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(uri)
        part, number, out, offsets, size, draft, row = TaskContext.get().partitionId(), 0, None, [], 0, "", 0

        def close() -> pa.RecordBatch:
            out.write(bytes(2 * BLOCK))
            out.close()
            name = f"{part:06d}-{number:03d}.tar"
            write_file(f"{uri}/{name}{INDEX}", [np.array(offsets, np.int64)])
            put(store, draft, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "members": [len(offsets)], "bytes": [size]})

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)).to_pylist(), strict=True):
                if out is None:
                    draft = f"{folder}/_{part:06d}-{number:03d}-{uuid.uuid4().hex}.tmp"
                    out, offsets, size = store.open_output_stream(draft), [], 0
                media = to_png(payload_of(text.encode()))
                head = header(f"{part:06d}_{row:012d}_{'' if doc_id is None else doc_id}.png", media)
                offsets.append(out.tell())
                out.write(head + media + bytes(-len(media) % BLOCK))
                size, row = size + len(media), row + 1
                if size >= ARCHIVE:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "archive string, members long, bytes long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Member(NamedTuple):
    archive: str
    offset: int
    name: str | None
    media: bytes | None
    error: str | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.size = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        store, folder = open_fs(self.uri)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".tar"))
        return [ByteRange(p, a, a + self.size) for p, n in files for a in range(0, n, self.size)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        if partition.path:
            store, _ = open_fs(self.uri)
            for member in members(store, partition.path, partition.start, partition.end):
                held.append(member)
                size += len(member.media or b"")
                if size >= BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


class ArchiveSource(DataSource):
    """spark.read.format("quadloom_archive").load(folder): members of the folder's tar archives."""

    @classmethod
    def name(cls) -> str:
        return "quadloom_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def _batch(held: list[Member]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], list(Member._fields))


def members(store: fs.FileSystem, path: str, start: int, end: int) -> Iterator[Member]:
    """Members whose header lies in [start, end), found by hopping from header to header on one handle."""
    name, at = path.rsplit("/", 1)[-1], _begin(store, path, start)
    with store.open_input_file(path) as file:
        size = file.size()
        while at < min(end, size):
            head = file.read_at(BLOCK, at)
            if head == bytes(BLOCK) or len(head) < BLOCK:
                at += BLOCK
                continue
            try:
                info = tarfile.TarInfo.frombuf(head, "utf-8", "strict")
            except (tarfile.HeaderError, UnicodeDecodeError):
                bad, at = at, at + BLOCK
                while at < size and not _valid(file.read_at(BLOCK, at)):
                    at += BLOCK
                if start <= bad < end:
                    yield Member(name, bad, None, None, f"damaged header, {at - bad} bytes passed over")
                continue
            if at >= start:
                media, error = _media(store, path, at + BLOCK, info, file)
                yield Member(name, at, info.name, media, error)
            at += BLOCK + -(-info.size // BLOCK) * BLOCK


def _begin(store: fs.FileSystem, path: str, start: int) -> int:
    """Where to hop from: the last indexed header before start, if there is an index."""
    if not start or store.get_file_info(path + INDEX).type != fs.FileType.File:
        return 0
    with store.open_input_file(path + INDEX) as file:
        offsets = np.frombuffer(file.read(), np.int64)
    at = int(np.searchsorted(offsets, start)) - 1
    return int(offsets[at]) if at >= 0 else 0


def _valid(head: bytes) -> bool:
    try:
        tarfile.TarInfo.frombuf(head, "utf-8", "strict")
    except (tarfile.HeaderError, UnicodeDecodeError):
        return False
    return True


def _media(store: fs.FileSystem, path: str, at: int, info: tarfile.TarInfo, file: pa.NativeFile) -> tuple[bytes | None, str | None]:
    """The member's bytes; while they fail their checksum they are read again, on a new handle."""
    error = None
    for attempt in range(TRIES):
        try:
            with contextlib.nullcontext(file) if not attempt else store.open_input_file(path) as source:
                media = source.read_at(info.size, at)
            if len(media) == info.size and (not info.uname.startswith("crc32-") or info.uname == f"crc32-{zlib.crc32(media):08x}"):
                return media, None
            error = "damaged member"
        except OSError as e:
            error = str(e)
    return None, error


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_features(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each member in the folder: its id and digests of its payload and media, or an error."""
    spark.dataSource.register(ArchiveSource)
    stored = spark.read.format("quadloom_archive").load(uri).select("name", "media", "error")
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]

    def row(name: str | None, media: bytes | None, error: str | None) -> tuple:
        at = name.rsplit("_", 1)[-1].removesuffix(".png") if name else ""
        doc_id, sha = int(at) if at else None, hashlib.sha256
        try:
            if media is None:
                raise ValueError(error)
            samples = from_png(media)
        except (ValueError, zlib.error) as e:
            return (doc_id, *[None] * 7, str(e))
        payload = samples.tobytes()
        return doc_id, len(payload.rstrip(FILL)), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha(media).hexdigest(), feature(samples), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [row(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return stored.mapInArrow(run, SCHEMA)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs' payloads to archives in a new shared folder and reads their features back."""
    uri = work_dir(docs.sparkSession, "media")
    write_archives(docs.select(F.col(id_col).cast("long"), F.col(text)), uri).agg(F.sum("members")).collect()
    return read_features(docs.sparkSession, uri)
